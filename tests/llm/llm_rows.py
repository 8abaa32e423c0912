"""Documents with all that operators must stand: nulls, empty and very long texts, ties, repeated rows, clashing names of columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, kept boolean, spans string, digest string, start long"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_RNG = random.Random(5)
_WORDS = ["".join(_RNG.choice("abcdefghiklmnoprstuvwz") for _ in range(_RNG.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


def row(doc_id, text, source="s0", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), "k", 1, False, "x", "y", 3)


def all_rows():
    shared = prose(70, "shared")
    texts = [prose(60, i) for i in range(6)]
    near = texts[1].split()
    near[30] = "changed"
    # a text that is a copy but for white space, equal texts, a long one, one with itself twice, one that repeats a word
    rows = [row(i + 10, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [row(3, texts[0].replace(" ", "\t\n", 5), "s1"), row(40, texts[0]), row(41, " ".join(near))]
    rows += [row(50, f"{prose(20, 50)} {shared} {prose(20, 51)}", "s2"), row(51, f"{shared} {prose(30, 52)}", None), row(52, prose(15000, 53), "s2")]
    rows += [row(60, f"{prose(60, 60)} {prose(60, 60)}"), row(61, "ha " * 500, "s1"), row(62, "ünï cödé 字 𝒳 " * 40, "s1", None)]
    rows += [row(70, None), row(71, ""), row(72, " \t\n"), row(73, "one"), row(74, "one two"), row(None, "no identifier here"), row(75, "ONE Two")]
    rows += [row(80, prose(30, 80)), row(80, prose(30, 80))]
    return rows
