"""The glyph catalog: bounding boxes, validation of words, and their layout on a line."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Strokes of each glyph, as x,y:x,y for lines and kind@x,y*radius for arcs.
#: Arcs: o is a circle; r, d, l and u are half circles that bulge right, down, left and up.
GLYPHS = """
   0,-4:4,-4
A  0,0:2,8 2,8:4,0 1,4:3,4
B  0,0:0,8 0,0:2,0 0,4:2,4 0,8:2,8 r@2,6*2 r@2,2*2
C  0,2:0,6 u@2,6*2 d@2,2*2
D  0,0:0,8 0,0:1,0 0,8:1,8 r@1,4*4
E  0,0:0,8 0,0:3,0 0,4:2,4 0,8:3,8
F  0,0:0,8 0,4:2,4 0,8:3,8
G  4,0:5,0 5,0:5,3.5 3.5,3.5:5,3.5 4,8:5,8 l@4,4*4
H  0,0:0,8 4,0:4,8 0,4:4,4
I  0,0:2,0 1,0:1,8 0,8:2,8
J  4,2:4,8 2,8:4,8 d@2,2*2
K  0,0:0,8 0,4:4,8 0,4:4,0
L  0,0:0,8 0,0:3,0
M  0,0:0,8 0,8:2,4 2,4:4,8 4,0:4,8
N  0,0:0,8 0,8:4,0 4,0:4,8
O  0,2:0,6 4,2:4,6 u@2,6*2 d@2,2*2
P  0,0:0,8 0,4:2,4 0,8:2,8 r@2,6*2
Q  0,2:0,6 4,2:4,6 2,2:4,0 u@2,6*2 d@2,2*2
R  0,0:0,8 0,4:2,4 0,8:2,8 1,4:4,0 r@2,6*2
S  u@2,6*2 l@2,6*2 r@2,2*2 d@2,2*2
T  2,0:2,8 0,8:4,8
U  0,2:0,8 4,2:4,8 d@2,2*2
V  0,8:2,0 2,0:4,8
W  0,8:2,0 2,0:4,4 4,4:6,0 6,0:8,8
X  0,0:4,8 0,8:4,0
Y  2,4:4,8 0,8:2,4 2,0:2,4
Z  0,0:4,0 0,0:4,8 0,8:4,8
0  0,2:0,6 2,3:2,5 4,2:4,6 u@2,6*2 d@2,2*2
8  o@2,2*2 o@2,6*2
#  0,2:5,2 1,6:6,6 1,0:3,8 3,0:5,8
"""
#: Half the thickness of a stroke, the advance of a space, and the leftmost start.
HALF, SPACE_ADVANCE, LEFTMOST = 0.5, 4.0, -16.0


@dataclass(frozen=True)
class Glyph:
    char: str
    lines: tuple[tuple[float, float, float, float], ...]
    arcs: tuple[tuple[str, float, float, float], ...]  # kind, x, y, radius

    @property
    def box(self) -> tuple[float, float, float, float]:
        """Least and greatest x and y of the strokes, half a stroke wider: a half circle reaches no further than its centre where it is open."""
        xs = [x for a, _, b, _ in self.lines for x in (a, b)]
        ys = [y for _, a, _, b in self.lines for y in (a, b)]
        for kind, x, y, r in self.arcs:
            xs += [x - r] * (kind != "r") + [x + r] * (kind != "l")
            ys += [y - r] * (kind != "u") + [y + r] * (kind != "d")
        return min(xs) - HALF, max(xs) + HALF, min(ys) - HALF, max(ys) + HALF

    @property
    def width(self) -> float:
        low, high, _, _ = self.box
        return high - low


@cache
def catalog() -> dict[str, Glyph]:
    out = {}
    for row in GLYPHS.strip("\n").split("\n"):
        strokes = row[2:].split()
        lines = [tuple(float(v) for p in s.split(":") for v in p.split(",")) for s in strokes if "@" not in s]
        arcs = [(s[0], *(float(v) for v in s[2:].split("*")[0].split(",")), float(s.split("*")[1])) for s in strokes if "@" in s]
        out[row[0]] = Glyph(row[0], tuple(lines), tuple(arcs))
    return out


def glyph_table(spark: SparkSession) -> DataFrame:
    """char, lines and curves: a table of 30 rows, whatever the input."""
    rows = [(g.char, list(g.lines), list(g.arcs)) for g in catalog().values()]
    return spark.createDataFrame(rows, "char string, lines array<struct<x0:double,y0:double,x1:double,y1:double>>, curves array<struct<kind:string,cx:double,cy:double,r:double>>")


def boxes(glyphs: DataFrame) -> DataFrame:
    """char, x_min, x_max, y_min, y_max, width, by an aggregate over the strokes."""
    lines = glyphs.select("char", F.explode("lines").alias("s")).select("char", F.array(F.struct(F.col("s.x0").alias("x"), F.col("s.y0").alias("y")), F.struct(F.col("s.x1").alias("x"), F.col("s.y1").alias("y"))).alias("p"))
    points = lines.select("char", F.explode("p").alias("p")).select("char", "p.x", "p.y")
    c = glyphs.select("char", F.explode("curves").alias("c")).select("char", "c.*")
    side = lambda open_to, v: F.when(F.col("kind") != open_to, v)
    reach = c.select("char", side("r", F.col("cx") - F.col("r")).alias("x0"), side("l", F.col("cx") + F.col("r")).alias("x1"), side("u", F.col("cy") - F.col("r")).alias("y0"), side("d", F.col("cy") + F.col("r")).alias("y1"))
    curved = reach.select("char", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("char", "p.x", "p.y")
    out = points.unionByName(curved).groupBy("char").agg(
        (F.min("x") - HALF).alias("x_min"), (F.max("x") + HALF).alias("x_max"), (F.min("y") - HALF).alias("y_min"), (F.max("y") + HALF).alias("y_max")
    )
    return out.withColumn("width", F.col("x_max") - F.col("x_min"))


_SMALL, _CAPITALS = "abcdefghijklmnopqrstuvwxyzıſ", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def upper(text: Column) -> Column:
    """Letter by letter, so that no character turns into two."""
    return F.translate(text, _SMALL, _CAPITALS)


def unknown_characters(text: Column) -> Column:
    """The characters of a text that the catalog lacks, in order."""
    return F.regexp_replace(upper(text), "[A-Z08# ]", "")


def validate(word: str) -> str:
    """The word in capitals; ValueError at the first character that the catalog lacks."""
    word = word.translate(str.maketrans(_SMALL, _CAPITALS))
    for c in word:
        if c not in catalog():
            raise ValueError(f"{word!r} has {c!r}, which has no glyph")
    return word


def layout(words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """word, pos, char, x for the glyphs of each word: centred, started no further left than LEFTMOST; spaces advance and show nothing."""
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("pos", "char")).where("char <> ''")
    sized = chars.join(F.broadcast(boxes(glyphs).select("char", "width")), "char")
    advance = F.when(F.col("char") == " ", SPACE_ADVANCE).otherwise(F.col("width") + 1)
    word = Window.partitionBy("word")
    before = F.coalesce(F.sum("advance").over(word.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = F.greatest(F.lit(LEFTMOST), -((F.sum("advance").over(word) - 1) / 2) + HALF)
    placed = sized.withColumn("advance", advance).select("word", "pos", "char", (start + before).alias("x"))
    return placed.where("char <> ' '")


def layout_of(word: str) -> list[tuple[str, float]]:
    """The same for one word, on the driver."""
    advance = [SPACE_ADVANCE if c == " " else catalog()[c].width + 1 for c in word]
    x = max(LEFTMOST, -((sum(advance) - 1) / 2) + HALF)
    out = []
    for c, a in zip(word, advance, strict=True):
        if c != " ":
            out.append((c, x))
        x += a
    return out
