"""Near-duplicate lines by a segment-partition edit join, in DataFrame and SQL functions only.

Two lines are near when at most `max_edits` insertions, deletions or substitutions of characters part them. A line is cut
into max_edits + 1 segments, one of which survives in any near line; segments are indexed by the line's length, the
segment's place and its characters. A line probes the index for its own and all shorter lengths within max_edits, and
only with the substrings whose shift the edits left and right of the segment allow. Candidates whose letter counts
already differ too much are never made; the rest is verified by a banded bit-parallel edit distance on what is left
after the common head and tail.

Classes are the connected components of near lines. Of a class the first occurrence stays (smallest doc_id, then the
first line); all others are dropped. Lines too short for the edit join form classes by equality alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import id_text
from .graph import components

MAX_EDITS, LEAST_CHARS = 2, 20
#: Rows of a broadcast id list: 8 bytes each, so 32 MB at most; beyond it the join shuffles.
BROADCAST_IDS = 4_000_000
_LETTERS = "etaoinshrd"  # counted modulo 4, two bits each; each costs a pass over every line


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, pos, line) of all lines of *least_chars* characters or more that are not blank."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.filter((F.length("line") >= least_chars) & F.col("line").rlike("[^ \\x09-\\x0D]"))


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment *i* (from 1) of *k*; the last segments are the longer ones."""
    base, rest = F.floor(length / k).cast("int"), (length % k).cast("int")
    start = 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - (k - rest))
    return start, base + (F.lit(i) > k - rest).cast("int")


def _key(length: Column, i: int, part: Column) -> Column:
    return F.xxhash64(length, F.lit(i), part)


def index_rows(lines: DataFrame, max_edits: int) -> DataFrame:
    """(key, id, sig): the segments of every line."""
    k, n = max_edits + 1, F.col("size")
    keys = [_key(n, i, F.substring(F.col("line"), *_segment(n, i, k))) for i in range(1, k + 1)]
    return lines.select(F.explode(F.array(*keys)).alias("key"), "id", "sig")


def probe_rows(lines: DataFrame, max_edits: int) -> DataFrame:
    """(key, same, id, sig): the substrings that can be a segment of a line as long (`same`) or up to *max_edits* shorter.

    A substring beyond the line's ends is cut short and equals no segment of that place.
    """
    k, n, keys, own = max_edits + 1, F.col("size"), [], 0
    for less in range(max_edits + 1):
        for i in range(1, k + 1):
            start, size = _segment(n - less, i, k)
            low = max(-(i - 1), less - (k - i))
            high = min(i - 1, less + (k - i))
            keys += [_key(n - less, i, F.substring(F.col("line"), start + shift, size)) for shift in range(low, high + 1)]
        own = own or len(keys)
    rows = lines.select(F.posexplode(F.array(*keys)).alias("pos", "key"), "id", "sig")
    return rows.select("key", (F.col("pos") < own).alias("same"), "id", "sig")


def letter_counts(line: Column) -> Column:
    """Counts of some letters modulo 4 in one number."""
    sig = F.lit(0)
    for j, c in enumerate(_LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        sig = sig.bitwiseOR(F.shiftleft(count % 4, 2 * j))
    return sig


def _letters_apart(a: str, b: str) -> str:
    """Lower bound of the sum of count differences; an edit moves it by two at most."""
    terms = []
    for j in range(len(_LETTERS)):
        x, y = (f"(shiftrightunsigned({c}, {2 * j}) & 3)" for c in (a, b))
        terms.append(f"least(({x} - {y}) & 3, ({y} - {x}) & 3)")
    return " + ".join(terms)


def banded_distance(a: str, b: str, max_edits: int) -> str:
    """SQL for the edit distance of columns *a* and *b*, or some number above *max_edits*.

    The lengths differ by *max_edits* at most. Bit k of a word stands for row (column - max_edits + k); the words hold
    where the distance rises (vp) or falls (vn) from one row to the next, and `dist` follows the lowest diagonal of the
    band and then the last row.
    """
    t, mask = max_edits, (1 << (2 * max_edits + 1)) - 1
    least = f"(least(length({a}), length({b})) - {t + 1})"
    common = ("CASE WHEN {room} < 1 THEN 0 ELSE aggregate(sequence(CAST(floor(log2({room})) AS INT), 0, -1), 0, (n, e) -> "
              "CASE WHEN n + shiftleft(1, e) <= {room} AND {end}({a}, n + shiftleft(1, e)) = {end}({b}, n + shiftleft(1, e)) THEN n + shiftleft(1, e) ELSE n END) END")
    head = common.format(room=least, end="left", a=a, b=b)
    tail = common.format(room=f"({least} - h)", end="right", a=a, b=b)
    match = " | ".join(f"CASE WHEN get(p.x, j - {t + 1 - k}) <=> get(p.y, j - 1) AND j - {t + 1 - k} >= 0 AND j - {t - k} <= p.m THEN {1 << k}L ELSE 0L END"
                       for k in range(2 * t + 1))
    hp = f"((s.vn | ~(d | s.vp)) & {mask}L)"
    step = f"""transform(array({match}), eq -> transform(array(((((eq & s.vp) + s.vp) ^ s.vp) | eq | s.vn) & {mask}L), d -> struct(
        ((d & s.vp) | ~(shiftright(d, 1) | {hp})) & {mask}L AS vp, shiftright(d, 1) & {hp} AS vn,
        s.dist + CASE WHEN j <= p.m - {t} THEN 1L - (shiftright(d, {2 * t}) & 1L)
                      ELSE (shiftright({hp}, p.m - j + {t}) & 1L) - (shiftright(d & s.vp, p.m - j + {t}) & 1L) END AS dist))[0])[0]"""
    start = f"struct({((1 << (t + 1)) - 1) << t}L AS vp, 0L AS vn, {t}L AS dist)"
    walk = f"aggregate(sequence(1, p.n), {start}, (s, j) -> CASE WHEN s.dist > {2 * t} + {t} THEN s ELSE {step} END, s -> s.dist)"
    core = "split(substring({c}, h + 1, length({c}) - h - e), '')"
    words = f"struct({core.format(c=a)} AS x, {core.format(c=b)} AS y, length({a}) - h - e AS m, length({b}) - h - e AS n)"
    return f"transform(array({head}), h -> transform(array({tail}), e -> transform(array({words}), p -> {walk})[0])[0])[0]"


def with_signature(lines: DataFrame) -> DataFrame:
    """Add length and letter counts, which both sides of the join read from the written table."""
    return lines.withColumns({"size": F.length("line"), "sig": letter_counts(F.col("line"))})


def near_lines(lines: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b) with a < b: all near pairs of the distinct lines given as `with_signature` gives them (id, line, size, sig)."""
    probes, index = probe_rows(lines, max_edits).alias("p"), index_rows(lines, max_edits).alias("i")
    met = probes.join(index, F.expr(f"p.key = i.key AND (p.id > i.id OR NOT p.same) AND {_letters_apart('p.sig', 'i.sig')} <= {2 * max_edits}"))
    pairs = cut_lineage(met.select(F.least("p.id", "i.id").alias("a"), F.greatest("p.id", "i.id").alias("b")).distinct(), "line-pairs")
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "line-ids")
    some = cut_lineage(lines.select("id", "line").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), "line-texts")
    texts = pairs.join(some.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(some.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return texts.filter(F.expr(banded_distance("x", "y", max_edits)) <= max_edits).select("a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, class, first_doc): lines of classes with two occurrences or more; h1 and h2 hash the line."""
    each = lines_of(docs, id_col, text_col, 1).groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    each = each.filter((F.length("line") >= least_chars) | (F.col("n") > 1))
    distinct = cut_lineage(with_signature(each.withColumn("id", F.monotonically_increasing_id())), "lines", compression="zstd")
    labels = components(cut_lineage(near_lines(distinct.filter(F.col("size") >= least_chars), max_edits), "near-lines"))
    hashes = [F.xxhash64(F.lit(k), "line").alias(f"h{k}") for k in (1, 2)]
    small = labels.count() <= BROADCAST_IDS
    single = distinct.filter("n > 1").join(F.broadcast(labels) if small else labels, F.col("id") == F.col("node"), "left_anti").select(
        *hashes, F.col("id").alias("class"), "first_doc")
    linked = distinct.join(F.broadcast(labels) if small else labels, F.col("id") == F.col("node")).select(*hashes, F.col("label").alias("class"), "first_doc")
    first = linked.groupBy("class").agg(F.min("first_doc").alias("first_doc"))
    return single.unionByName(linked.drop("first_doc").join(first, "class"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, dropped): sorted numbers (from 0) of the lines to drop, for documents that have any."""
    classes = line_classes(docs, id_col, text_col, max_edits, least_chars)
    places = lines_of(docs, id_col, text_col, 1).select("doc_id", "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))
    met = places.join(classes, ["h1", "h2"]).repartition("doc_id")
    here = met.groupBy("doc_id", "class", "first_doc").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gone = F.when(F.col("doc_id").eqNullSafe(F.col("first_doc")), F.expr("slice(at, 2, size(at))")).otherwise(F.col("at"))
    return here.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list(gone))).alias("dropped")).filter(F.size("dropped") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, least_chars: int = LEAST_CHARS,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of *docs*: doc_id, n_lines, n_dropped, dropped, cleaned.

    n_lines counts all lines; `dropped` holds the numbers of the dropped ones; `cleaned` is the text without them. Lines
    of fewer than *least_chars* characters go only as exact repeats; blank lines always stay. A NULL text has no line and stays NULL, an empty
    one has one. Rows that share a doc_id are one document: what its first occurrence keeps, each of them keeps. NULL ids
    are one document that comes last. Columns named in *carry* come back in a struct `carried`.
    """
    gone = dropped_lines(docs, id_col, text_col, max_edits, least_chars).withColumnRenamed("doc_id", "gone_id")
    rows = id_text(docs, id_col, text_col, carry).withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.expr(
        "array_join(filter(split(text, '\n', -1), (l, k) -> NOT array_contains(dropped, k)), '\n')"))
    return rows.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"), kept.alias("cleaned"),
                       *(["carried"] if carry else []))
