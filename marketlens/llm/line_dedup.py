"""Line dedup by content-defined chunks of lines (native DataFrame operations only).

A rolling hash runs over the hashes of neighbouring lines that are not blank.
Under a cut rule (a multiplier) a chunk stands where the rolling hash is
larger than its two neighbours: cuts come before and after those two lines.
Where a passage is cut depends on its own lines and the next ones alone, so
copies are cut alike whatever stands before. ``RULES`` rules cut every text
independently, so that short passages, whose lines at the edge border on other
ones in each text, have whole chunks under some rule. Chunks that occur more
than once in the corpus and are equal byte for byte go, except the first
occurrence (by doc_id, then place); of a text all lines go that lie in
such a chunk. Whatever goes stands earlier in the corpus, and the first
occurrence of a line always stays.

Only hashes travel until it is known what repeats: chunks are two line hashes
of 60 bits (partial sums before the shuffle, so one chunk may occur in any
share of the documents). Documents are then joined once to what they lose, and
the lines of repeated chunks are compared by their bytes: where two different lines
have one hash, their chunks are grouped again with the lines themselves.

Defined cases: a null text stays null, an empty one stays empty; one-line
texts lose nothing; blank lines are no part of a chunk and stay or go with
the line before them; a text that loses all its lines becomes empty; rows
equal in doc_id and text count as one document and share its result; a null
doc_id comes first; an empty table gives an empty one; steps are linear in a
text, however long; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.session import write_table

#: Cut rules; with 12, both edges of a passage lie in a chunk of some rule for about 19 of 20 pairs of texts.
RULES = 12
#: Hexadecimal digits of a line's hash.
DIGITS = 15
#: The rolling hash: first line times ``FACTOR`` plus second, modulo a prime; a rule multiplies it once more.
PRIME = 2**31 - 1
FACTOR = 31
MULTIPLIERS = [pow(48271, 1 + 97 * r, PRIME) for r in range(RULES)]

_FULL = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text.cast("string"), "\n", -1)


def _line_hash(line: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(line), 1, digits), 16, 10).cast("long")


def _hashed(docs: DataFrame, id_col: str, text_col: str, digits: int) -> DataFrame:
    """(row_id, row_hash, hashes): a hash of each line that is not blank; a written table without texts."""
    full = F.filter(_lines(F.col(text_col)), lambda line: line.rlike(_FULL))
    d = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_hash"),
                    F.transform(full, lambda line: _line_hash(line, digits)).alias("hashes"))
    return write_table(d.filter(F.size("hashes") > 1), "line-hashes")


def _chunks(hashed: DataFrame) -> DataFrame:
    """(at, a, b): the chunks of all rules, by place of the first line and hashes of both lines."""
    n = F.size("hashes") - 1
    d = hashed.withColumn("first", F.slice("hashes", 1, n)).withColumn("second", F.slice("hashes", 2, n))
    d = d.withColumn("rolling", F.zip_with("first", "second", lambda a, b: (a % PRIME * FACTOR + b % PRIME) % PRIME))
    none = F.array(F.lit(-1).cast("long"))
    d = d.withColumn("before", F.concat(none, F.slice("rolling", 1, n - 1))).withColumn("after", F.concat(F.slice("rolling", 2, n - 1), none))

    def chosen(x: Column) -> Column:
        rules = [(x["rolling"] * m % PRIME > x["before"] * m % PRIME) & (x["rolling"] * m % PRIME >= x["after"] * m % PRIME) for m in MULTIPLIERS]
        out = rules[0]
        for r in rules[1:]:
            out = out | r
        return out

    d = d.withColumn("cuts", F.transform(F.arrays_zip("rolling", "before", "after"), chosen))
    at = F.transform(F.arrays_zip("first", "second", "cuts"), lambda x, i: F.when(x["cuts"], F.struct(
        i.alias("place"), x["first"].alias("a"), x["second"].alias("b"))))
    d = d.select("row_id", "row_hash", F.explode(F.array_compact(at)).alias("c"))
    return d.select(F.struct("row_id", "row_hash", "c.place").alias("at"), "c.a", "c.b")


def _repeats(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(row_id, row_hash, repeated, gone): places of the repeated chunks of a document, and of those that go."""
    # rows equal in id and text give equal occurrences, which are no repeat
    twice = chunks.groupBy(*key).agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last").drop("last")
    # a written table: next to its sums the join could not be split where one chunk is very common
    twice = write_table(twice, "line-repeats").withColumnsRenamed({k: f"{k}_2" for k in key})
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    c = chunks.join(twice, same)
    return c.groupBy("at.row_id", "at.row_hash").agg(
        F.collect_set("at.place").alias("repeated"), F.collect_set(F.when(F.col("at") != F.col("first"), F.col("at.place"))).alias("gone"))


def _both_lines(places: str) -> Column:
    return F.array_distinct(F.concat(places, F.transform(places, lambda i: i + 1)))


def _joined(docs: DataFrame, repeats: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents beside what repeats in them, written: row (the other columns), row_id, row_hash, parts, repeated, gone.

    ``parts``: blank lines that open the text, then each line that is not
    blank with the blank ones after it, all with '\\n' before. Lines
    are joined with two-character marks, '\\n\\n' before one that is not blank
    and '\\n ' otherwise; as no line holds '\\n', splitting at '\\n\\n' gives them.
    """
    others = [c for c in docs.columns if c != text_col]
    d = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col(id_col).alias("row_id"),
                    F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).cast("string").alias("text"))
    r = repeats.withColumnsRenamed({"row_id": "id_2", "row_hash": "hash_2"})
    # documents are the large side at any size: never broadcast the other, which grows with them
    d = d.join(r.hint("merge"), F.col("row_id").eqNullSafe(F.col("id_2")) & (F.col("row_hash") == F.col("hash_2")), "left")
    marked = F.array_join(F.transform(_lines(F.col("text")), lambda line: F.concat(F.when(line.rlike(_FULL), "\n\n").otherwise("\n "), line)), "")
    d = d.withColumn("marked", marked)
    parts = F.transform(F.split("marked", "\n\n", -1), lambda p, i: F.concat(F.when(i > 0, "\n").otherwise(""), F.replace(p, F.lit("\n "), F.lit("\n"))))
    return write_table(d.select("row", "row_id", "row_hash", parts.alias("parts"), "repeated", "gone"), "line-documents")


def _unequal(joined: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """Lines of repeated chunks as (row_id, row_hash, line_place, hash, line), and the hashes that two different ones have."""
    d = joined.filter(F.size("repeated") > 0).select("row_id", "row_hash", F.explode(F.transform(
        _both_lines("repeated"), lambda i: F.struct(i.alias("line_place"), F.element_at("parts", i + 2).alias("part")))).alias("l"))
    line = F.split(F.substr("l.part", F.lit(2)), "\n", 2)[0]
    d = d.select("row_id", "row_hash", "l.line_place", line.alias("line")).withColumn("hash", _line_hash(F.col("line"), digits))
    # distinct first: it keeps one row a task of a line that is very common
    found = d.groupBy("hash", "line").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    return d, write_table(found.select("hash"), "line-unequal")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, digits: int = DIGITS) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text_col``; ``n_chars``, if there, is kept true.

    With ``counts``: one column more, ``line_dedup`` (struct of n_lines, n_removed: lines that are not blank).
    """
    chunks = _chunks(_hashed(docs, id_col, text_col, digits))
    joined = _joined(docs, _repeats(chunks, ["a", "b"]), id_col, text_col)
    lines, unequal = _unequal(joined, digits)
    if not unequal.isEmpty():  # different lines of one hash: their chunks count as equal only with equal lines
        named = lines.join(unequal, "hash", "left_semi").select("row_id", "row_hash", "line_place", "line").distinct()
        named = write_table(named, "line-named")
        c = chunks.select("at", "a", "b", F.col("at.row_id").alias("i"), F.col("at.row_hash").alias("h"), F.col("at.place").alias("p"))
        for name, step in (("line_a", 0), ("line_b", 1)):
            of = named.select(F.col("row_id").alias("i2"), F.col("row_hash").alias("h2"), (F.col("line_place") - step).alias("p2"), F.col("line").alias(name))
            c = c.join(of, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")) & (F.col("p") == F.col("p2")), "left").drop("i2", "h2", "p2")
        joined = _joined(docs, _repeats(c.select("at", "a", "b", "line_a", "line_b"), ["a", "b", "line_a", "line_b"]), id_col, text_col)
    d = joined.withColumn("out", F.when(F.size("gone") > 0, _both_lines("gone")))
    n_lines = F.greatest(F.size("parts") - 1, F.lit(0))
    d = d.select("row", "parts", "out", n_lines.alias("n_lines"), F.greatest(F.size("out"), F.lit(0)).alias("n_removed"))
    stay = F.array_except(F.sequence(F.lit(1), F.col("n_lines")), F.transform("out", lambda i: i + 1))
    kept = F.concat(F.element_at("parts", 1), F.array_join(F.transform(stay, lambda i: F.element_at("parts", i + 1)), ""))
    text = F.when(F.col("n_removed") == 0, F.array_join("parts", "")).when(F.col("n_removed") < F.col("n_lines"), kept)
    text = F.when(F.col("parts").isNotNull(), F.coalesce(F.substr(text, F.lit(2)), F.lit("")))
    d = d.select("row", text.alias("text"), F.struct("n_lines", "n_removed").alias("counts"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("counts.n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    if counts:
        out.append(F.col("counts").alias("line_dedup"))
    return d.select(*out)


def dedup_sql(digits: int = DIGITS) -> str:
    """DuckDB form over ``documents``: doc_id, n_lines, n_removed, text."""
    rules = " OR ".join(f"(v * {m} % {PRIME} > p * {m} % {PRIME} AND v * {m} % {PRIME} >= s * {m} % {PRIME})" for m in MULTIPLIERS)
    return rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled FROM l),
u AS (SELECT *, sum(filled::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS u FROM b),
h AS (SELECT doc_id, u, line, ('0x' || substr(md5(line), 1, {digits}))::BIGINT AS h FROM u WHERE filled),
r AS (
  SELECT *, lead(line) OVER w AS line2, (h % {PRIME} * {FACTOR} + lead(h) OVER w % {PRIME}) % {PRIME} AS v
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
n AS (
  SELECT *, coalesce(lag(v) OVER w, -1) AS p, coalesce(lead(v) OVER w, -1) AS s
  FROM r WHERE v IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
c AS (SELECT doc_id, u, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, u) > 1 AS gone FROM n WHERE {rules}),
g AS (SELECT doc_id, u FROM c WHERE gone UNION SELECT doc_id, u + 1 FROM c WHERE gone),
t AS (
  SELECT u.doc_id, count(*) FILTER (WHERE filled)::INT AS n_lines, count(*) FILTER (WHERE filled AND g.u IS NOT NULL)::INT AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.u IS NULL) AS text
  FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.u = g.u GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE t.text END AS text
FROM documents d LEFT JOIN t USING (doc_id)
"""


DEDUP_SQL = dedup_sql()
