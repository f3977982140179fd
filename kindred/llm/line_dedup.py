"""Line dedup: content-defined chunks of lines, removed where they repeat anywhere in the corpus.

A text is cut at line ends into lines and lines are hashed. A rolling hash over each two lines in
turn, (31 h[i] + h[i-1]) mod 2^31 - 1, has a local minimum about every third line; a chunk ends there.
The boundary depends on four lines only, so a passage is cut alike wherever it stands, whatever was put
in front of it, and no chunk but a text's last has one line. Chunks of two lines or more are units. A
passage that is shorter than a chunk, or holds none whole, would stay; so from each line on the shortest
run of whole lines (up to LOOK of them) with over `long_line` words is a unit too. Every repeated passage of
whole lines with more words begins with such a run, and its every line but those of its last `long_line`
words begins one in it.

Units that occur more than once are removed everywhere but at their first place (least doc_id, then line).
A line goes if any removed unit holds it; the first place of a unit stays, less what repeats an earlier one.

Units are found by 128-bit hashes of their lines' hashes; the texts of repeated units, at the first place and at
all others, are then compared byte by byte in one aggregate, and a unit whose hash stands for two texts is left in
place. Nothing but hashes and places is shuffled for all rows; a unit with very many places
is one row after partial aggregation, and what is joined with it is not shuffled.

Only DataFrame functions are used. A null text stays null and has no lines; a null doc_id sorts first.
Rows equal in doc_id and text count as one document and keep or lose the same lines. A text that loses
all lines becomes empty. Very long texts are worked on line by line. Other columns pass through, whatever
their names; `removed` must be a new name or ValueError is raised. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, identity, join_groups, materialize

PRIME = 2147483647
WORD = r"[^\x20\x09-\x0D]+"
#: Words and lines so far are one number: lines below, words above.
LINES = 20


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_digest(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def line_hash(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def chunk_ranges(hashes: Column) -> Column:
    """start and n of each chunk of a list of line hashes."""
    def cuts(r: Column) -> Column:
        last = F.size(r) - 1
        inner = lambda i: (i >= 1) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | inner(i))

    rolled = F.transform(hashes, lambda h, i: (h * 31 + F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long"))) % PRIME)

    def ranges(ends: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            return F.struct(start.alias("start"), (end - start + 1).alias("n"))

        return F.transform(ends, one)

    return _let(_let(rolled, cuts), ranges)


def run_ranges(words: Column, long_line: int) -> Column:
    """start and n of the shortest run of over long_line words from each line with a word on, where there is one."""
    enough = lambda size: F.shiftright(size, LINES) > long_line

    def runs(full: Column) -> Column:
        def run(line: Column, k: Column) -> Column:
            # Each line has a word: no more than these are needed, and nothing is added beyond long_line words.
            size = F.aggregate(
                F.slice(full, k + 1, long_line + 1), F.lit(0).cast("long"), lambda a, x: F.when(enough(a), a).otherwise(a + x["words"] * (1 << LINES) + 1)
            )
            last = lambda size: F.get(full, k + size.bitwiseAND(F.lit((1 << LINES) - 1).cast("long")).cast("int") - 1)["at"]
            n = _let(size, lambda size: F.when(enough(size), last(size) - line["at"] + 1).otherwise(0))
            return F.struct(line["at"].alias("start"), n.alias("n"))

        return F.filter(F.transform(full, run), lambda r: r["n"] > 0)

    numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("words")))
    return _let(F.filter(numbered, lambda line: line["words"] > 0), runs)


def units_of(text: str, long_line: int) -> Column:
    """start, n, key of the units of a text that may be removed."""
    def found(lines: Column) -> Column:
        chunks = lambda digests: F.filter(_let(F.transform(digests, line_hash), chunk_ranges), lambda c: c["n"] > 1)
        words = F.transform(lines, lambda line: F.regexp_count(line, F.lit(WORD)).cast("long"))
        runs = _let(words, lambda w: run_ranges(w, long_line))

        def keyed(digests: Column) -> Column:
            key = lambda u: F.unhex(F.md5(F.array_join(F.slice(digests, u["start"] + 1, u["n"]), "")))
            # A chunk that is a run too stands twice: array_distinct would compare all with all.
            return F.transform(F.concat(chunks(digests), runs), lambda u: F.struct(u["start"].alias("start"), u["n"].alias("n"), key(u).alias("key")))

        return _let(F.transform(lines, line_digest), keyed)

    return _let(F.split(F.col(text), "\n"), found)


def _doubtful(rows: DataFrame, held: DataFrame) -> DataFrame:
    """key of units whose places, the first among them, do not hold one text: none, if hashes are good."""
    held = held.groupBy("who").agg(F.collect_list(F.struct("start", "n", "key")).alias("held"))
    own = rows.select("who", "text").join(held, "who").select(F.explode("held").alias("u"), F.split("text", "\n").alias("lines"))
    texts = own.select("u.key", F.array_join(F.slice("lines", F.col("u.start") + 1, F.col("u.n")), "\n").alias("unit"))
    return texts.groupBy("key").agg(F.min("unit").alias("least"), F.max("unit").alias("most")).filter("least <> most").select("key")


def repeated_units(docs: DataFrame, long_line: int = 50) -> DataFrame:
    """who, doc_id, start, n of each unit to remove; who is the identity of doc_id and text."""
    rows = docs.filter("text is not null").select(identity("doc_id", "text").alias("who"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = rows.select("who", "doc_id", F.explode(units_of("text", long_line)).alias("u")).select("who", "doc_id", "u.start", "u.n", "u.key")
    places = materialize(units, "units")
    # Repeated rows are one place: they are told from others by more than one who, doc_id and start.
    place = F.struct("doc_id", "who", "start")
    groups = places.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("times")).filter("first <> last")
    groups = materialize(groups.select("key", "first", "times"), "repeats")
    met = join_groups(places, groups, "key", "times", places.count())
    met = materialize(met.select("who", "doc_id", "start", "n", "key", (place != F.col("first")).alias("later")).distinct(), "later")
    discard(places)
    discard(groups)
    wrong = materialize(_doubtful(rows, met), "doubtful")
    return met.filter("later").join(wrong, "key", "left_anti").select("who", "doc_id", "start", "n")


def remove_repeats(docs: DataFrame, long_line: int = 50, removed: str = "removed_lines") -> DataFrame:
    """docs with repeated units taken out of text, and how many lines each row lost."""
    if removed.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {removed} exists already")
    gone = repeated_units(docs, long_line).groupBy("who").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    # Lines to remove, each once; rows travel as one column, so that no name can clash.
    numbers = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1))))
    gone = gone.select("who", F.array_sort(numbers).alias("gone"))
    joined = docs.select(identity("doc_id", "text").alias("who"), F.struct("*").alias("row")).join(gone, "who", "left")
    lines = F.split(F.col("row.text"), "\n")
    # What stands between removed lines is kept: a slice from behind each of them up to the next.
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(lines)))
    kept = F.flatten(_let(lines, lambda own: _let(edges, lambda e: F.transform(F.slice(e, 2, F.size(e) - 1), lambda z, k: F.slice(own, F.get(e, k) + 2, z - F.get(e, k) - 1)))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), removed_lines, text of every document."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    before = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_lines.alias("n_lines"))
    return remove_repeats(before).select("doc_id", "n_lines", "removed_lines", "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
), rolled AS (
  SELECT *, (h * 31 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 2147483647 AS r, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM hashed
), marked AS (
  SELECT *, CASE WHEN i >= 1 AND r < lag(r) OVER w AND r <= lead(r) OVER w OR lead(r) OVER w IS NULL THEN 1 ELSE 0 END AS cut
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM marked
), chunks AS (
  SELECT doc_id, min(i) AS start, count(*) AS n FROM numbered GROUP BY doc_id, k HAVING count(*) > 1
), whole AS (
  SELECT doc_id, list(line ORDER BY i) AS ls, list(upto ORDER BY i) AS us FROM numbered GROUP BY doc_id
), runs AS (
  SELECT m.doc_id, m.i AS start, list_position(list_transform(us[m.i + 1:], lambda u: u - m.upto + m.w > 50), true) AS n
  FROM numbered m JOIN whole o ON o.doc_id = m.doc_id WHERE m.w > 0
), units AS (
  SELECT doc_id, start, n FROM chunks UNION SELECT doc_id, start, n FROM runs WHERE n > 0
), placed AS (
  SELECT u.*, array_to_string(ls[u.start + 1:u.start + u.n], chr(10)) AS unit FROM units u JOIN whole o ON o.doc_id = u.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start) AS place FROM placed
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM ranked WHERE place > 1
), kept AS (
  SELECT m.doc_id, count(*) AS n_lines, count(g.i) AS removed_lines, coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM numbered m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.i = g.i GROUP BY m.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.removed_lines, 0)::BIGINT AS removed_lines, k.text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
