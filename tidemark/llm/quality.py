"""Quality rules with DataFrame functions only: base counts, then divergence from references of each language.

The base counts words, symbols, repeated lines and words in repeated windows of three.  A
document that they pass is compared with a reference of its language by Jensen-Shannon
divergence (in bits): the histogram of its words over the language's common words and all
others, and the histogram of its characters over seven classes.

References are learned from all documents that name a language.  Its common words are the
``COMMON`` words that occur in most of 64 groups of texts (dealt by a hash of the text), then
most often, among those that make up a share of 1 / COMMON_SHARE of its words.  A reference
histogram is the mean of those of the groups, each scaled to one, so that a text with very
many copies moves one group only.  Words are first counted by buckets of hashes; a bucket
that is too light for its language holds no common word, so only words of the others are
counted by name.  A language has a reference if it has a share of 1 / LANGUAGE_SHARE of all
words, hence there are at most so many.  A document without a language, or whose language
has no reference, is kept if any reference accepts it.

A short text strays from its reference by chance, in proportion to 1 / n: that is what the
thresholds allow on top of the divergence of long texts.  Guards: texts of fewer than
``MIN_WORDS`` words fail the base, classes aren't judged below ``MIN_CHARS`` characters, and a
language of fewer than ``MIN_REFERENCE`` words in all has no reference; without any
reference the base alone decides.

Defined results: null, empty and blank texts have no words and fail the base; ids may be
null or repeat, each row is judged by itself; equal texts of one language get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

MIN_WORDS = 50
#: Per cent of the words that may stand in repeated windows.
MAX_REPEATED = 50
MIN_CHARS = 200
MIN_REFERENCE = 2_000
COMMON = 32
COMMON_SHARE = 2_000
LANGUAGE_SHARE = 1_000
#: Divergence of words: at most the first number and the second divided by the number of words; the same for characters.
WORD_LIMIT = (0.04, 7.0)
CLASS_LIMIT = (0.06, 15.0)
GROUPS = 64
BUCKETS = 1 << 14
#: Reference histograms are whole numbers, in billionths of each group.
SCALE = 1_000_000_000

BLANKS = " \\t-\\r"
SYMBOLS = "#*$%&|<>"
#: Classes of characters, each counted among what those before it leave; what all leave is the last class.
CLASSES = ("[a-z]+", f"[{BLANKS}]+", "[A-Z]+", "[0-9]+", f"[{SYMBOLS}]+", "[\\p{L}\\p{M}]+")



def once(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are computed once for all their uses: Spark doesn't merge projections across a generator."""
    one = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_once")
    return df.select("*", one).select(*(c for c in df.columns if c not in columns), *(F.col(f"_once.{name}").alias(name) for name in columns))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of counts; null if one has no counts."""
    total = lambda x: F.nullif(F.aggregate(x, F.lit(0).cast("long"), lambda n, v: n + v), F.lit(0))
    part = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(F.lit(0.0))
    of = lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2)
    terms = F.zip_with(p, q, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    found = F.transform(F.array(sums), lambda s: F.aggregate(terms, F.lit(0.0), lambda n, x: n + of(x["a"] / s["p"], x["b"] / s["q"])))
    return F.get(found, 0) / (2 * math.log(2))


def _group(text: Column) -> Column:
    """One of 64 groups of texts."""
    return F.floor(F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int") / 4).cast("int")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, words): the common words of each language that can have a reference, most common first."""
    named = docs.select("lang", F.col("text").cast("string").alias("text")).where("lang is not null")
    named = once(named, group=_group(F.col("text"))).select("lang", "group", F.explode(words_of(F.col("text"))).alias("word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    buckets = saved(named.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n")))
    totals = buckets.groupBy("lang").agg(F.sum("n").alias("total"))
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    # At most LANGUAGE_SHARE languages, each with at most COMMON_SHARE buckets.
    totals = totals.where((F.col("total") * LANGUAGE_SHARE >= every) & (F.col("total") >= MIN_REFERENCE))
    heavy = saved(buckets.join(F.broadcast(totals), "lang").where(F.col("n") * COMMON_SHARE >= F.col("total")).select("lang", "bucket", "total"))
    counted = named.withColumn("bucket", bucket).join(F.broadcast(heavy), ["lang", "bucket"]).groupBy("lang", "total", "word")
    counted = counted.agg(F.count("*").alias("n"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, group)"))).alias("spread")).where(F.col("n") * COMMON_SHARE >= F.col("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("spread"), F.desc("n"), "word"))
    best = counted.withColumn("place", place).where(F.col("place") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("best"))
    return totals.join(best, "lang", "left").select("lang", F.coalesce(F.col("best.word"), F.array().cast("array<string>")).alias("words"))


def _with_own(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the row of ``of`` (at most LANGUAGE_SHARE) for the row's ``lang``, in a list, or all of them by lang if there is none."""
    one = F.struct(*of.columns)
    own = of.select(F.col("lang").alias("_lang"), F.array(one).alias("_own"))
    every = of.agg(F.sort_array(F.collect_list(one)).alias("_every")).withColumn("_key", F.lit(1))
    rows = rows.join(F.broadcast(own), F.col("lang") == F.col("_lang"), "left")
    rows = rows.join(F.broadcast(every), F.when(F.col("_own").isNull(), 1) == F.col("_key"), "left")
    return rows.withColumn(name, F.coalesce("_own", "_every")).drop("_lang", "_own", "_every", "_key")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_repeat_words``, from ``hashes``, those of the words.

    Windows are compared by their 64-bit hashes.  33 bits of one and its place make a long, and
    these are sorted: equal windows come together, but for a few of the same 33 bits, which
    the whole hashes of the next two on either side tell apart.
    """
    places = F.when(F.size("hashes") < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("hashes") - 3))
    window = lambda at: F.xxhash64(*(F.get("hashes", at + k) for k in range(3)))
    low = (1 << 31) - 1
    rows = once(rows, order=F.sort_array(F.transform(places, lambda i: window(i).bitwiseAND(~low).bitwiseOR(i))))
    like = lambda x, i: x.bitwiseXOR(F.coalesce(F.get("order", i), F.bitwise_not(x))).bitwiseAND(~low) == 0
    rows = once(rows, order=F.filter("order", lambda x, i: like(x, i - 1) | like(x, i + 1)))
    rows = once(rows, order=F.transform("order", lambda x: x.bitwiseAND(low).cast("int")))
    rows = once(rows, wholes=F.transform("order", window))
    near = lambda at, i, k: F.coalesce(F.get("wholes", i) == F.get("wholes", i + k), F.lit(False))
    rows = once(rows, order=F.sort_array(F.filter("order", lambda at, i: near(at, i, -1) | near(at, i, 1) | near(at, i, -2) | near(at, i, 2))))
    covered = F.transform("order", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("order", i + 1) - at, F.lit(3))))  # up to the next one
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x)).drop("wholes", "order")


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the base counts, ``classes`` (characters by class) and ``found``, a list of
    (lang, counts): how often each common word of the language occurs, then all others; of all languages, if its own has none."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rest, sizes = F.col("text"), [F.length("text")]
    for kind in CLASSES:
        rest = F.regexp_replace(rest, kind, "")
        sizes.append(F.length(rest))
    sizes.append(F.lit(0))
    classes = F.array(*((a - b).cast("long") for a, b in zip(sizes, sizes[1:])))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    rows = rows.withColumn("classes", classes)  # a projection shares the nested replacements, a generator wouldn't
    rows = once(rows, words=words_of(F.col("text")), lines=lines, group=_group(F.col("text"))).drop("text")
    held = lambda n: F.get("classes", F.lit(n))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda n, v: n + v)
    rows = rows.select(
        "doc_id", "lang", "group", "words", "classes",
        F.size("words").cast("long").alias("n_words"), (chars - held(1)).alias("word_chars"), held(4).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )

    rows = once(rows, hashes=F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    rows = _with_repeats(rows)

    rows = _with_own(rows, common.select("lang", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")), "asked")
    times = lambda h: F.coalesce(F.size("hashes") - F.size(F.array_remove(F.col("hashes"), h)), F.lit(0)).cast("long")
    of_one = F.slice(F.array(*(times(F.get(F.get("asked", 0)["hashes"], F.lit(i))) for i in range(COMMON))), 1, F.size(F.get("asked", 0)["hashes"]))  # unrolled, so compiled
    # In a projection, not in a generator, whose code would be one method, too long to be compiled.
    rows = rows.withColumn("hits", F.when(F.size("asked") == 1, F.array(of_one)).otherwise(F.transform("asked", lambda x: F.transform(x["hashes"], times))))
    others = lambda x: F.col("n_words") - F.aggregate(x, F.lit(0).cast("long"), lambda n, v: n + v)
    found = F.zip_with("asked", "hits", lambda x, hits: F.struct(x["lang"].alias("lang"), F.concat(hits, F.array(others(hits))).alias("counts")))
    return rows.withColumn("found", found).drop("hits", "asked", "hashes")


def references(rows: DataFrame) -> DataFrame:
    """(lang, words, classes): the reference histograms; ``rows`` as ``features`` gives them."""
    own = rows.where((F.size("found") == 1) & (F.get("found", F.lit(0))["lang"] == F.col("lang")))
    parts = {"words": (F.get("found", F.lit(0))["counts"], COMMON + 1), "classes": (F.col("classes"), len(CLASSES) + 1)}
    sums = [F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)).alias(f"{name}{i}") for name, (c, n) in parts.items() for i in range(n)]
    groups = own.groupBy("lang", "group").agg(*sums)
    scaled = []
    for name, (_, n) in parts.items():
        groups = groups.withColumn(f"{name}_all", reduce(lambda x, y: x + y, (F.col(f"{name}{i}") for i in range(n))))
        scaled += [F.sum(F.when(F.col(f"{name}_all") > 0, F.expr(f"(cast({name}{i} as decimal(20,0)) * {SCALE}) div {name}_all"))).cast("long").alias(f"{name}{i}") for i in range(n)]
    means = groups.groupBy("lang").agg(*scaled)
    return means.select("lang", *(F.array(*(F.coalesce(F.col(f"{name}{i}"), F.lit(0).cast("long")) for i in range(n))).alias(name) for name, (_, n) in parts.items()))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): n_words, the base counts, base_failed, kept, and ``judged``: for each language
    that it was compared with the divergences ``words`` and ``classes``; null if the base failed."""
    common = saved(common_words(docs))
    rows = saved(features(docs, common))
    known = saved(references(rows))
    n, chars = F.col("n_words"), F.aggregate("classes", F.lit(0).cast("long"), lambda n, v: n + v)
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    rows = once(_with_own(rows, known, "known"), base_failed=failed, chars=chars)

    def compare(x: Column, of: Column) -> Column:
        padded = F.concat(x["counts"], F.array_repeat(F.lit(0).cast("long"), COMMON + 1 - F.size(x["counts"])))  # as long as the reference
        return F.struct(x["lang"].alias("lang"), divergence(padded, of["words"]).alias("words"), divergence(F.col("classes"), of["classes"]).alias("classes"))

    rows = once(rows, judged=F.when(~F.col("base_failed"), F.zip_with("found", "known", compare)))
    near = lambda found, limit, n: F.coalesce(found <= F.lit(limit[0]) + F.lit(limit[1]) / n, F.lit(True))
    fits = lambda x: near(x["words"], WORD_LIMIT, F.col("n_words")) & ((F.col("chars") < MIN_CHARS) | near(x["classes"], CLASS_LIMIT, F.col("chars")))
    kept = ~F.col("base_failed") & ((F.size("judged") == 0) | F.exists("judged", fits))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "judged")


_REST = ", ".join(f"c{n} as (select *, regexp_replace(r{n}, '{kind}', '', 'g') as r{n + 1} from {f'c{n - 1}' if n else 'texts'})" for n, kind in enumerate(CLASSES))
_SIZES = ", ".join([f"length(r{n}) - length(r{n + 1})" for n in range(len(CLASSES))] + [f"length(r{len(CLASSES)})"])


def _sql_divergence(name: str) -> str:
    """SQL: from {name}_of (doc_id, lang, grp, place, n) the references of all languages and each document's divergence."""
    term = lambda a, b: f"case when {a} > 0 then {a} * ln({a} / (({a} + {b}) / 2)) else 0 end"
    return f"""
  {name}_group as (select lang, grp, place, sum(n) as n, sum(sum(n)) over (partition by lang, grp) as total from {name}_of group by lang, grp, place),
  {name}_mean as (select lang, place, sum(n::hugeint * {SCALE} // total) as n from {name}_group where total > 0 group by lang, place),
  {name}_share as (select lang, place, n / sum(n) over (partition by lang) as q from {name}_mean),
  {name}_pair as (select doc_id, n / sum(n) over (partition by doc_id) as p, q from {name}_of join {name}_share using (lang, place)),
  {name}_js as (select doc_id, sum({term("p", "q")} + {term("q", "p")}) / (2 * ln(2.0)) as js from {name}_pair group by doc_id)"""


#: Documents of a language without a reference aren't compared with the others here: the tables have none; ids are distinct there.
ORACLE_SQL = f"""
with
  texts as (select doc_id, lang, coalesce(text, '') as r0, cast(('0x' || substr(md5(coalesce(text, '')), 1, 2)) as int) // 4 as grp from documents),
  {_REST},
  split as (
    select doc_id, lang, grp, list_filter(string_split_regex(r0, '[ \\t-\\r]+'), lambda x: x <> '') as words, [{_SIZES}] as classes,
      list_filter(string_split(r0, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as lines
    from c{len(CLASSES) - 1}),
  said as (select doc_id, lang, grp, unnest(words) as word from split where lang is not null),
  totals as (select lang, count(*) as total from said group by lang having count(*) * {LANGUAGE_SHARE} >= (select count(*) from said) and count(*) >= {MIN_REFERENCE}),
  counted as (
    select lang, word, count(*) as n, count(distinct grp) as spread
    from said join totals using (lang) group by lang, word having count(*) * {COMMON_SHARE} >= any_value(total)),
  common as (select lang, word, row_number() over (partition by lang order by spread desc, n desc, word) as place from counted qualify place <= {COMMON}),
  hits as (select doc_id, place, count(*) as n from said join common using (lang, word) group by doc_id, place),
  all_hits as (select doc_id, sum(n) as n from hits group by doc_id),
  slots as (select lang, unnest(range(1, {COMMON} + 2)) as place from totals),
  word_of as (
    select d.doc_id, lang, grp, place, case when place > {COMMON} then len(words) - coalesce(a.n, 0) else coalesce(h.n, 0) end as n
    from split d join slots s using (lang) left join hits h using (doc_id, place) left join all_hits a on a.doc_id = d.doc_id),
  class_of as (select doc_id, lang, grp, unnest(range({len(CLASSES) + 1})) as place, unnest(classes) as n from split where lang in (select lang from totals)),
  {_sql_divergence("word")}, {_sql_divergence("class")},
  windows as (
    select doc_id, unnest(range(1, len(words) - 1)) as pos, unnest(list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2]))) as w
    from split where len(words) > 2),
  twice as (select doc_id, pos from windows qualify count(*) over (partition by doc_id, w) > 1),
  repeated as (select doc_id, count(distinct pos + k) as n from twice, (select unnest(range(3)) as k) group by doc_id),
  base as (
    select doc_id, len(words) as n_words, list_sum(classes) as chars, list_sum(classes) - classes[2] as word_chars, classes[5] as n_symbols,
      len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
    from split left join repeated using (doc_id)),
  failed as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from base)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(w.js <= {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / n_words, true) and (chars < {MIN_CHARS} or coalesce(c.js <= {CLASS_LIMIT[0]} + {CLASS_LIMIT[1]} / chars, true)) as kept
from failed left join word_js w using (doc_id) left join class_js c using (doc_id)
"""
