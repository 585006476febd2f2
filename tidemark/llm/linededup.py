"""Line deduplication with DataFrame functions only: an edit-distance join over segment partitions.

A line is dropped if an earlier document, or an earlier place of its document, holds an
equal line or one within as many edits as the shorter of the two allows: one for every 30
characters, at least one, at most the cube root of its length, or the fixed ``max_edits``.
Lines shorter than ``min_chars`` characters have to be equal; blank lines are always kept.

If two lines are within k edits, one of k + 1 segments of the shorter stands unchanged in
the longer, shifted by no more than the edits before it, seen from the left, and by no more
than those after it, seen from the right.  So lines are dealt to bands of similar lengths, in
which segments have one size: the first half of them is counted from the start of the line
and the others from its end.  Each line enters the index of its band with its segments and
probes it, and the band below if that is near enough, with its substrings at the shifts that
are possible.  That is about (k + 1)^2 / 2 keys a line.  Candidates are verified by a banded
edit distance.

Defined results: a null text stays null and an empty one empty, both without lines to
drop; rows with the same doc_id and text are one document and get equal results; order is
by (doc_id, text hash, line number) with null ids first; an empty table gives an empty
result; other columns are kept as they are, but for those named like the ones that are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

MIN_CHARS = 20
#: A line allows one edit for so many characters.
CHARS_AN_EDIT = 30
#: A band spans so many lengths for each edit that it allows.
BAND_WIDTH = 8
#: Ids of up to so many candidate lines are broadcast; beyond that they are joined by a shuffle.
BROADCAST_LINES = 500_000
#: A line that makes up a share of 1 / HOT of all repeated ones is dealt to SALTS tasks; there are at most HOT of them.
HOT, SALTS = 500, 64
#: Letters whose counts, beside the length, are compared before a candidate is emitted; each has so many bits, so that ten fit into one long.
PROFILED, PROFILE_BITS = "enaitroshl", 5
#: Letters whose counts, beside the length, are compared before a candidate is verified, as many in each group as fit into one long.
COUNTED, COUNT_BITS = "enai", 11
MORE_COUNTED = ("trosl", "dcump", "ghvfb", "wyzkj")
#: Equal characters at both ends of two lines are cut off in pieces of so many, the longest first, before their edits are counted.
PIECES = [1 << n for n in range(16, 2, -1)]
#: Segments are joined in so many rounds, one after the other, so that the keys of one only lie on disk at a time.
ROUNDS = 2
#: Stands for a null id.
NO_ID = -(2**63)


def edits(length: Column) -> Column:
    """How many edits a line of this length allows: never fewer than a shorter one."""
    root = F.floor(F.cbrt(length + F.lit(0.5)))  # the half keeps roots of cubes whole
    return F.greatest(F.lit(1), F.least(F.floor(length / CHARS_AN_EDIT), root)).cast("int")


def _band(length: Column, max_edits: int | None) -> tuple[Column, Column]:
    """The edits that lines of this length allow, and the least length of their band; no band is narrower than its edits."""
    if max_edits is not None:
        width = BAND_WIDTH * max(1, max_edits)
        return F.lit(max_edits), (length - length % width).cast("int")
    k = edits(length)
    least = lambda k: F.when(k > 1, F.greatest(k * CHARS_AN_EDIT, k * k * k)).otherwise(F.lit(0))
    width, start = k * BAND_WIDTH, least(k)
    last = F.greatest(F.floor((least(k + 1) - start) / width), F.lit(1)) - 1  # takes what is left over
    return k, (start + F.least(F.floor((length - start) / width), last) * width).cast("int")


def _code(line: Column) -> Column:
    """One byte for each character, so that substrings are found without counting; equal characters have equal bytes."""
    return F.when(F.octet_length(line) == F.length(line), line.cast("binary")).otherwise(F.encode(F.regexp_replace(line, "[^\u0000-\u00ff]", "?"), "ISO-8859-1"))


def _ring(n: Column, bits: int) -> Column:
    """A code of a count whose Hamming distances are distances on a ring of 2 * bits places: never more than the counts differ."""
    full = (1 << bits) - 1
    codes = [(1 << m) - 1 for m in range(bits)] + [full ^ ((1 << m) - 1) for m in range(bits)]
    return F.get(F.lit(codes), n % (2 * bits)).cast("long")


def _count(line: Column, letter: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))


def _codes(first: Column, counts: list[Column], bits: int) -> Column:
    """``first`` and the codes of the counts, side by side in one long."""
    return reduce(lambda out, n: F.shiftleft(out, bits).bitwiseOR(_ring(n, bits)), counts, first.cast("long"))


def _profile(line: Column, k: Column) -> Column:
    """k and the codes of the length and of the counted letters; an edit changes at most two of these counts by one."""
    return _codes(k, [F.length(line), *(_count(line, letter) for letter in PROFILED)], PROFILE_BITS)


def _bags(line: Column) -> list[Column]:
    """The codes of the length and of all counted letters, in several longs."""
    groups = [[F.length(line), *(_count(line, letter) for letter in COUNTED)]]
    groups += [[_count(line, letter) for letter in group] for group in MORE_COUNTED]
    return [_codes(F.lit(0), counts, COUNT_BITS).alias(f"bag{n}") for n, counts in enumerate(groups)]


def _bag_gap() -> Column:
    """By how many steps the bags of two lines differ at least: no more than two for each edit."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"bag{n}_a").bitwiseXOR(F.col(f"bag{n}_b"))) for n in range(len(MORE_COUNTED) + 1)))


def _keys(lines: DataFrame, max_edits: int | None, turn: int = 0, rounds: int = 1) -> DataFrame:
    """key, profile and p, the even id of the line plus one if the key is of its own segment; ``lines`` has (h, line).

    Of the segments only every ``rounds``-th one, from number ``turn`` on.

    What can be computed for a line or a segment is, so that little is left for each key.
    """
    length, i, k, size = (F.col(c) for c in ("length", "i", "k", "size"))
    rows = lines.select("h", F.length("line").alias("length"), "line")
    allowed, band = _band(length, max_edits)
    rows = rows.select("h", "length", _code(F.col("line")).alias("code"), _profile(F.col("line"), allowed).alias("profile"), band.alias("own_band"))
    below = F.col("own_band") - 1  # the greatest length of the band below
    reached = (below > 0) & (length - below <= _band(below, max_edits)[0])
    rows = rows.select("*", F.explode(F.when(reached, F.array(length, below)).otherwise(F.array(length))).alias("like"))
    edits_there, band = _band(F.col("like"), max_edits)
    rows = rows.select("h", "length", "code", "profile", "own_band", edits_there.alias("k"), band.alias("band"))
    rows = rows.select("*", F.floor(F.col("band") / (k + 1)).cast("int").alias("size"), F.explode(F.sequence(F.lit(turn), F.greatest(k, F.lit(turn)), F.lit(rounds))).alias("i")).where(i <= k)
    base = F.when(2 * i <= k, i * size).otherwise(length - (k - i + 1) * size)
    rows = rows.select("h", "code", "profile", "length", "own_band", "band", "size", "k", "i", base.alias("base"), F.least(i, k - i).alias("reach"))
    low, high = F.greatest(F.col("base") - F.col("reach"), F.lit(0)), F.least(F.col("base") + F.col("reach"), length - size)
    segment = F.struct("k", "band", "i")
    own = F.when(F.col("own_band") == F.col("band"), F.col("base")).otherwise(F.lit(-1))
    rows = rows.select(F.xxhash64(segment).alias("segment"), "h", "code", "profile", "size", own.alias("own"), low.alias("low"), high.alias("high")).where("low <= high")
    rows = rows.select("segment", "h", "code", "profile", "size", "own", F.explode(F.sequence("low", "high")).alias("at"))
    key = F.xxhash64("segment", F.substring(F.col("code"), F.col("at") + 1, size))
    return rows.select(key.alias("key"), "profile", F.col("h").bitwiseAND(-2).bitwiseOR((F.col("at") == F.col("own")).cast("long")).alias("p"))


def candidates(lines: DataFrame, max_edits: int | None = None, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(a, b), a < b: even ids of lines that may be within the allowed edits; ``lines`` has (h, line), both distinct.

    Keys are shuffled once: the condition looks at both sides, so both read the same exchange.
    A key of very many lines is a skewed partition of a plain join, which AQE splits.
    """
    keys = _keys(lines, max_edits, turn, rounds)
    a, b = (keys.select("key", F.col("p").alias(f"p{x}"), F.col("profile").alias(f"counts_{x}")) for x in "ab")
    bits = PROFILE_BITS * (1 + len(PROFILED))
    counts = (1 << bits) - 1
    gap = F.bit_count(F.col("counts_a").bitwiseXOR(F.col("counts_b")).bitwiseAND(counts))
    k = F.shiftright(F.least("counts_a", "counts_b"), bits)
    met = (a["key"] == b["key"]) & (gap <= 2 * k) & (F.col("pa").bitwiseOR(F.col("pb")).bitwiseAND(1) == 1) & (F.col("pa").bitwiseAND(-2) < F.col("pb").bitwiseAND(-2))
    return a.join(b, met).select(F.col("pa").bitwiseAND(-2).alias("a"), F.col("pb").bitwiseAND(-2).alias("b")).distinct()


def edit_candidates(lines: DataFrame, max_edits: int | None = None) -> DataFrame:
    """(a, b), a < b: ids of distinct lines that may be within the allowed edits; ``lines`` has (id, line), ids distinct."""
    held = lines.withColumn("h", F.xxhash64("line"))
    found = candidates(held.select("h", "line"), max_edits)
    ids = held.select("id", F.col("h").bitwiseAND(-2).alias("even"))
    for x in "ab":
        found = found.join(ids.select(F.col("even").alias(x), F.col("id").alias(f"id_{x}")), x)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _same_start() -> Column:
    """How many characters rest_a and rest_b have in common at the start, but for less than the least piece; they have to differ."""
    same = lambda at, n: F.substring("rest_a", at + 1, n) == F.substring("rest_b", at + 1, n)
    return F.aggregate(F.lit(PIECES), F.lit(0), lambda at, n: F.when(same(at, n), at + n).otherwise(at))


def within(pairs: DataFrame) -> DataFrame:
    """The pairs (line_a, line_b, allowed) of different lines that are at most ``allowed`` edits apart.

    Edits are counted between what is left of the lines when equal ends are cut off, which has as many.
    """
    pairs = pairs.withColumns({f"rest_{x}": F.col(f"line_{x}") for x in "ab"})
    for _ in range(2):  # the start, then the end
        pairs = pairs.withColumn("at", F.explode(F.array(_same_start())))  # found once for all uses
        rests = F.struct(*(F.reverse(F.substring(f"rest_{x}", F.col("at") + 1, F.length(f"rest_{x}"))).alias(f"rest_{x}") for x in "ab"))
        pairs = pairs.withColumn("rests", F.explode(F.array(rests))).drop("at", "rest_a", "rest_b").select("*", "rests.*").drop("rests")
    return pairs.where("levenshtein(rest_a, rest_b, allowed) >= 0").drop("rest_a", "rest_b")


def near_lines(lines: DataFrame, max_edits: int | None = None) -> DataFrame:
    """(line_a, line_b), once: the different lines that are within the allowed edits; ``lines`` has (line), repeats allowed."""
    hashed = lines.withColumn("h", F.xxhash64("line"))
    distinct = lines.distinct().withColumn("h", F.xxhash64("line"))
    pairs = reduce(DataFrame.union, [saved(candidates(distinct, max_edits, turn, ROUNDS)) for turn in range(ROUNDS)]).distinct()
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("even")).distinct())
    few = ids.count() <= BROADCAST_LINES
    texts = hashed.withColumn("even", F.col("h").bitwiseAND(-2)).join(F.broadcast(ids) if few else ids, "even", "left_semi")
    texts = texts.select("even", "line").distinct().select("even", F.length("line").alias("length"), *_bags(F.col("line")), "line")
    texts = saved(texts)
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("even").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in texts.columns if c != "even")), x)
    k, _ = _band(F.least("length_a", "length_b"), max_edits)
    close = pairs.withColumn("allowed", k).where((F.abs(F.col("length_a") - F.col("length_b")) <= F.col("allowed")) & (_bag_gap() <= 2 * F.col("allowed")))
    return within(close.select("line_a", "line_b", "allowed")).select("line_a", "line_b")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key that is never null, so that every join below shuffles the documents in the same way, once."""
    return docs.withColumn("key_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("key_t", F.coalesce(F.xxhash64("text"), F.lit(0)))


def _id(line: Column) -> list[Column]:
    """128 bits that stand for a line: two hashes with different seeds."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


ID = ["h1", "h2"]


def repeated_lines(docs: DataFrame, max_edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """key_d, key_t and, per document with any, ``exact`` and ``near``: the line numbers (from 0) to drop, and ``links``."""
    every = _keyed(docs.select("doc_id", F.col("text").cast("string"))).select("key_d", "key_t", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    links = near_lines(every.where(F.length("line") >= min_chars).select("line"), max_edits)
    ends = saved(links.select(F.explode(F.array(F.struct(F.col("line_a").alias("line"), F.col("line_b").alias("other")), F.struct(F.col("line_b").alias("line"), F.col("line_a").alias("other")))).alias("x")).select(*_id(F.col("x.line")), F.struct(*_id(F.col("x.other"))).alias("other")))

    places = every.select("key_d", "key_t", "at", *_id(F.col("line")))
    place = F.struct("key_d", "key_t", "at")
    firsts = places.groupBy(*ID).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    of_other = firsts.select(F.struct(*ID).alias("other"), F.col("first").alias("first_other"))
    linked = ends.join(of_other, "other").groupBy(*ID).agg(F.min("first_other").alias("earliest"), F.count("*").alias("links"))
    judged = firsts.join(linked, ID, "left").where("n > 1 or links is not null")
    matter = saved(judged.select(*ID, "n", "first", F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("late"), F.coalesce("links", F.lit(0)).alias("links")))

    total = matter.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > F.lit(total)  # so there are fewer than HOT of them
    salted = places.join(F.broadcast(matter.where(hot).select(*ID, F.lit(True).alias("hot"))), ID, "left")
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key_d", "key_t"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
    dealt = matter.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    exact = F.col("first") != place
    told = F.struct("at", exact.alias("exact"), (~exact & F.col("late")).alias("near"), "links")
    found = salted.join(dealt, [*ID, "salt"]).groupBy("key_d", "key_t").agg(F.collect_set(told).alias("told"))  # repeated rows count once
    which = lambda kind: F.transform(F.filter("told", lambda x: x[kind]), lambda x: x.at)
    links = F.aggregate("told", F.lit(0).cast("long"), lambda n, x: n + x.links)
    return found.select("key_d", "key_t", which("exact").alias("exact"), which("near").alias("near"), links.alias("links"))


def dedup_lines(docs: DataFrame, max_edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with the lines dropped from text; ``lines``, ``exact``, ``near`` and ``links`` count its
    lines, those dropped as equal and as near, and the other lines that are near to one of its own."""
    base = docs.drop("key_d", "key_t", "parts", "lines", "exact", "near", "links").withColumn("text", F.col("text").cast("string"))
    found = repeated_lines(docs, max_edits, min_chars)
    keyed = _keyed(base)
    doc_id = F.col("doc_id")
    if dict(base.dtypes)["doc_id"] == "bigint":  # then the key says it, and it needn't be shuffled too
        keyed, doc_id = keyed.drop("doc_id"), F.nullif("key_d", F.lit(NO_ID))
    joined = keyed.join(found, ["key_d", "key_t"], "left")
    # Split once for all uses.
    joined = joined.withColumn("parts", F.explode(F.array(F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))))
    drop = F.concat("exact", "near")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), drop)
    kept = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    return joined.select(
        *(F.when(F.size(drop) > 0, kept).otherwise(F.col(c)).alias(c) if c == "text" else doc_id.alias(c) if c == "doc_id" else F.col(c) for c in base.columns),
        F.size("parts").alias("lines"),
        *(F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("exact", "near")),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


#: Letters beyond ASCII, in SQL one byte each, since DuckDB counts edits of bytes.
_LETTERS = "äöüßÄÖÜéèêëàâçñáíóúôîïûùœæÉÈÀÇÑÁÍÓÚ¿¡"

#: Of the k + 1 even parts of a line one stands unchanged in any line within k edits, at most k places away.
ORACLE_SQL = f"""
with
  lines as (
    select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
    from documents where text is not null),
  distinct_lines as (
    select line, min(doc_id * 1000000 + pos) as first, length(line) as n,
      translate(line, '{_LETTERS}', (select string_agg(chr(cast(case when x < 10 then x else x + 1 end as integer)), '' order by x) from range(1, {len(_LETTERS) + 1}) t(x))) as plain
    from lines where trim(line, ' ') <> '' group by line),
  classes as (
    select n, cast(greatest(1, least(n // {CHARS_AN_EDIT}, floor(cbrt(n + 0.5)))) as bigint) as k from (select distinct n from distinct_lines where n >= {MIN_CHARS})),
  parts as (
    select line, plain, first, n, k, i, n * i // (k + 1) as start, n * (i + 1) // (k + 1) - n * i // (k + 1) as size
    from distinct_lines join classes using (n), lateral (select unnest(range(0, k + 1)) as i)),
  probes as (
    select d.line, d.plain, d.first, c.n as other_n, s.k, s.i, substr(d.line, s.start + m.move + 1, s.size) as piece
    from distinct_lines d join classes c on c.n <= d.n and d.n - c.n <= c.k
    join (select distinct n, k, i, start, size from parts) s on s.n = c.n,
      lateral (select unnest(range(-s.k, s.k + 1)) as move) m
    where d.n >= {MIN_CHARS} and s.start + m.move >= 0 and s.start + m.move + s.size <= d.n),
  near_pairs as (
    select distinct p.line as a, q.line as b, p.first as a_first, q.first as b_first
    from parts p join probes q on q.other_n = p.n and q.i = p.i and q.piece = substr(p.line, p.start + 1, p.size)
    where p.line <> q.line and levenshtein(p.plain, q.plain) <= p.k),
  ends as (select a as line, b as other, b_first as other_first from near_pairs union select b, a, a_first from near_pairs),
  near_of as (select line, min(other_first) as earliest, count(*) as links from ends group by line),
  judged as (
    select l.doc_id, l.pos, l.line, coalesce(n.links, 0) as links,
      coalesce(l.doc_id * 1000000 + l.pos > d.first, false) as exact,
      coalesce(l.doc_id * 1000000 + l.pos = d.first and n.earliest < d.first, false) as near
    from lines l left join distinct_lines d on d.line = l.line left join near_of n on n.line = l.line),
  by_doc as (
    select doc_id, count(*) as lines, count(*) filter (exact) as exact, count(*) filter (near) as near, sum(links) as links,
      coalesce(string_agg(line, chr(10) order by pos) filter (not exact and not near), '') as kept
    from judged group by doc_id)
select d.doc_id, cast(coalesce(b.lines, 0) as integer) as lines, cast(coalesce(b.exact, 0) as integer) as exact,
  cast(coalesce(b.near, 0) as integer) as near, cast(coalesce(b.links, 0) as bigint) as links, md5(b.kept) as kept_md5
from documents d left join by_doc b on b.doc_id = d.doc_id
"""
