"""Boilerplate lines by distinct-site spread, as DataFrame functions only.

A HyperLogLog sketch of the sites of every line (by hash) estimates on how many
sites the line stands, a second one in how many distinct texts: a text that is
copied to many sites spreads none of its lines. Sketches are made where the lines
are read and merge by aggregation; lines of one site or one text get none.
Lines near a threshold get exact distinct counts; the rest are decided by the
estimates.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import joined_by, saved

#: Relative standard error of a sketch with 2^12 buckets is about 0.8 per cent at most; the band is six of them.
SKETCH_LG = 12
BAND = 0.05
#: Boilerplate hashes travel to the tasks as one value only up to this count (8 bytes each); beyond it lines are joined.
HELD_LINES = 200_000


def lines_of(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(text, site, h) of every non-blank line: the text's hash, the site and the line's hash.

    Lines are compared trimmed of spaces, by 64 bits of XXH64; texts by their MD5.
    """
    given = docs.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("text"), F.col(site_col).alias("site"), F.explode(F.split(text_col, "\n", -1)).alias("line"))
    trimmed = given.withColumn("line", F.trim("line")).where(F.col("line") != "")
    return trimmed.select("text", F.col("site").cast("string").alias("site"), F.xxhash64("line").alias("h"))


def _held(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.count() <= HELD_LINES else hashes


def boilerplate(lines: DataFrame, least: int) -> DataFrame:
    """Hashes h of the lines that stand on at least `least` distinct sites and in at least `least` distinct texts.

    A null site counts as none. A first pass keeps the lines that stand on two
    sites and in two texts, by the least and greatest of each. Of these, every
    task sketches the sites and texts of each line that it meets, and the
    sketches merge by aggregation: no (line, site) pairs travel. Lines whose
    estimates lie in the band around the threshold are counted exactly.
    """
    low, high = least * (1 - BAND) - 1, least * (1 + BAND) + 1
    ends = [F.min("site"), F.max("site"), F.min("text"), F.max("text")]
    spread = lines.groupBy("h").agg(*[x.alias(name) for x, name in zip(ends, ("s0", "s1", "t0", "t1"), strict=True)])
    enough = F.col("s0").isNotNull() if least < 2 else (F.col("s0") < F.col("s1")) & (F.col("t0") < F.col("t1"))
    spread = saved(spread.where(enough).select("h"))
    sketch = lambda column: F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(SKETCH_LG)))
    sketched = lines.join(_held(spread), "h", "left_semi").groupBy("h").agg(sketch("site").alias("sites"), sketch("text").alias("texts"))
    both = saved(sketched.where((F.col("sites") >= low) & (F.col("texts") >= low)))
    near = saved(both.where((F.col("sites") <= high) | (F.col("texts") <= high)).select("h"))
    pair = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("x"))
    pairs = lines.join(_held(near), "h", "left_semi").select("h", F.explode(F.array(pair(0, "site"), pair(1, "text"))).alias("p"))
    once = pairs.where(F.col("p.x").isNotNull()).distinct().groupBy("h").agg(F.count_if(F.col("p.kind") == 0).alias("exact_sites"), F.count_if(F.col("p.kind") == 1).alias("exact_texts"))
    told = both.join(once, "h", "left")
    return saved(told.where((F.coalesce("exact_sites", "sites") >= least) & (F.coalesce("exact_texts", "texts") >= least)).select("h"))


def drop_boilerplate(
    docs: DataFrame, least_sites: int = 8, whole_from: float = 1.0, text_col: str = "text", site_col: str = "source", size_col: str | None = "n_chars"
) -> DataFrame:
    """docs with the boilerplate lines taken out of their texts; all columns and rows stay.

    A line is boilerplate if, trimmed of spaces, it stands on at least
    `least_sites` distinct sites and in as many distinct texts. A text of which
    boilerplate makes up a share of `whole_from` or more of the characters in its
    lines stays whole: by default only one that has no line of its own, so that
    no document vanishes.

    The remaining lines keep their order; size_col, where it exists, is set to
    the new length of a changed text. Null texts and blank lines stay. What is
    dropped depends on the text alone, so repeated rows and ids are no special
    case. An empty table gives no rows. Columns of any name are carried along.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    text, site = f"c{names.index(text_col)}_", f"c{names.index(site_col)}_"
    bad = boilerplate(lines_of(own, text, site), least_sites)
    count = bad.count()
    marked = _left_in_place(own, text, bad, count) if count <= HELD_LINES else _left_by_join(own, text, bad)
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda total, line: total + F.char_length(F.trim(line)))
    every, left = F.split(text, "\n", -1), F.col("left_")
    gone = size(every) - size(left)
    changed = F.coalesce((gone > 0) & (gone < F.lit(whole_from) * size(every)), F.lit(False))
    out = marked.select(*own.columns, changed.alias("changed_"), F.array_join("left_", "\n").alias("left_"))
    columns = []
    for i, name in enumerate(names):
        column = F.col(f"c{i}_")
        if name == text_col:
            column = F.when(F.col("changed_"), F.col("left_")).otherwise(column)
        elif name == size_col:
            column = F.when(F.col("changed_"), F.char_length("left_").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return out.select(*columns)


def _left_in_place(own: DataFrame, text: str, bad: DataFrame, count: int) -> DataFrame:
    """Add left_, the lines that are no boilerplate, within a projection: nothing is shuffled.

    The hashes, HELD_LINES at most, are one value of the plan: slots of about
    one hash each, found by the line's own hash.
    """
    lines = F.split(text, "\n", -1)
    if not count:
        return own.withColumn("left_", lines)
    slots: list[list[int]] = [[] for _ in range(count)]
    for row in bad.collect():  # HELD_LINES at most
        slots[row["h"] % count].append(row["h"])
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>")  # folded into one constant

    def kept(line: Column) -> Column:
        h = F.xxhash64(F.trim(line))
        return (F.trim(line) == "") | ~F.array_contains(F.element_at(table, F.pmod(h, F.lit(count)).cast("int") + 1), h)

    return own.withColumn("left_", F.filter(lines, kept))


def _left_by_join(own: DataFrame, text: str, bad: DataFrame) -> DataFrame:
    """As _left_in_place, for any number of hashes: line numbers are found by a join and sent back to their texts.

    Texts are told apart by their MD5; a text with very many copies does not
    meet its line numbers in one task.
    """
    keyed = own.withColumn("key_", F.md5(text))
    numbered = keyed.where(F.col(text).isNotNull()).select("key_", F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    hashed = numbered.where(F.trim("line") != "").select("key_", "at", F.xxhash64(F.trim("line")).alias("h"))
    changes = hashed.join(bad, "h", "left_semi").groupBy("key_").agg(F.collect_set("at").alias("drop_"))
    joined = joined_by(keyed.where(F.col(text).isNotNull()), changes, "key_", "left")
    joined = joined.unionByName(keyed.where(F.col(text).isNull()).withColumn("drop_", F.lit(None).cast("array<int>")))
    lines = F.split(text, "\n", -1)
    left = F.filter(lines, lambda line, at: ~F.array_contains("drop_", at))
    return joined.withColumn("left_", F.when(F.col("drop_").isNull(), lines).otherwise(left)).drop("key_", "drop_")


def sql(least_sites: int = 8, whole_from: float = 1.0, docs: str = "documents") -> str:
    """The same in DuckDB SQL, over a table with doc_id, text, source and n_chars; other columns stay."""
    return f"""
    WITH given AS (SELECT *, row_number() OVER () AS row_ FROM {docs}),
    lines AS (
      SELECT row_, source, md5(text) AS text_, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM given WHERE text IS NOT NULL
    ),
    bad AS (
      SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {least_sites} AND count(DISTINCT text_) >= {least_sites}
    ),
    marked AS (SELECT l.row_, l.at, l.line, trim(l.line) IN (SELECT line FROM bad) AS bad FROM lines l),
    shares AS (
      SELECT row_, coalesce(sum(length(trim(line))) FILTER (WHERE bad), 0) AS bad_size, sum(length(trim(line))) AS size FROM marked GROUP BY 1
    ),
    changed AS (
      SELECT m.row_, coalesce(string_agg(m.line, chr(10) ORDER BY m.at) FILTER (WHERE NOT m.bad), '') AS text
      FROM marked m JOIN shares s USING (row_) WHERE s.bad_size > 0 AND s.bad_size < s.size * {whole_from} GROUP BY 1
    )
    SELECT g.* EXCLUDE (row_) REPLACE (CASE WHEN c.row_ IS NOT NULL THEN c.text ELSE g.text END AS text,
      CASE WHEN c.row_ IS NOT NULL THEN length(c.text) ELSE g.n_chars END AS n_chars)
    FROM given g LEFT JOIN changed c USING (row_)
    """
