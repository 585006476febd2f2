"""Mixing sources to target weights with DataFrame functions only: hierarchical budgeting.

A token budget runs down a tree of domain, language and source.  Every node shares its
budget among its children by their weights; a child that can't use its share, because all
its leaves together hold less, gets what it can use, and its siblings get the rest by
their weights.  Only what a whole subtree lacks reaches the level above.  Shares are
integers and add up to the budget, or to all there is.

A leaf's tokens are its documents in a seeded order, one order for each epoch, up to
``max_epochs`` of them; the leaf gets the prefix that its budget reaches.

Defined results: null texts have no tokens and are never taken; a null domain, language or
source counts as the empty name; rows with equal doc_id and text take their places in the
order one after the other; weights that aren't given are 1, a weight of 0 takes nothing;
an empty table or a budget of 0 gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

LEVELS = ("domain", "lang", "source")
SEED = 7
MAX_EPOCHS = 4
#: Hexadecimal digits by which a leaf's order is cut into ranges that are summed apart.
RANGE_DIGITS = 4
#: Up to so many leaves, their table is broadcast.
BROADCAST_LEAVES = 100_000


def count_tokens(text: Column) -> Column:
    """Runs of characters other than blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in sorted(weights.items()):
        out = F.when(name == value, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` (parents, name, capacity, weight, budget of the parent) with ``share``: the part of the budget of each."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = nodes.where("weight > 0 and capacity > 0").withColumn("full", F.col("capacity") * onward <= (F.col("budget") - before) * F.col("weight"))
    ranked = ranked.withColumn("place", F.row_number().over(order))
    first = F.min(F.when(~F.col("full"), F.col("place"))).over(by)
    ranked = ranked.withColumn("full", first.isNull() | (F.col("place") < first))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0))
    ranked = ranked.withColumn("rest", rest).withColumn("among", F.sum(F.when(~F.col("full"), F.col("weight"))).over(by))
    ranked = ranked.withColumn("part", F.expr("(rest * weight) div among"))
    over = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("part"))).over(by)
    nth = F.col("place") - F.sum(F.col("full").cast("int")).over(by)
    ranked = ranked.withColumn("more", (nth <= over).cast("long"))
    return ranked.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("part") + F.col("more")))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of every leaf that gets any; ``leaves`` has the tokens of each.

    The whole budget is ``budget_share`` of all tokens.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(budget_share)).cast("long").alias("budget"))
    above = total
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        nodes = nodes.join(above, path[:-1]) if depth else nodes.crossJoin(F.broadcast(above))  # one row
        above = share(nodes, path[:-1], level).select(*path, F.col("share").alias("budget"), "tokens").where("budget > 0")
        above = above.drop("tokens") if depth < len(LEVELS) - 1 else above
    return above


def mix_sources(docs: DataFrame, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What is taken, and the leaves.

    Taken: doc_id, text_key, domain, lang, source, tokens, epochs (how often the document is taken whole) and taken
    (tokens in all), for every row of ``docs`` (doc_id, text, domain, lang, source) that gives any.
    Leaves: the budget of each, and ``last``, the order key of the last document that fits whole into its last epoch.
    """
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long"),
            F.xxhash64("text").alias("text_key"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS),
            count_tokens(F.col("text")).alias("tokens"),
        )
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    given = saved(budgets(leaves, weights, budget_share, max_epochs).withColumn("epochs", F.expr("budget div tokens")).withColumn("partial", F.expr("budget % tokens")).drop("tokens"))
    ordered = rows.join(small(given), list(LEVELS)).withColumn("hash", order_hash(seed))
    ordered = ordered.withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    sums = ordered.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("sum"))
    ahead = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*LEVELS, "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("hash", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0))
    placed = ordered.withColumn("end", inside).join(sums, [*LEVELS, "range"]).withColumn("end", F.col("end") + F.col("ahead"))
    reach = F.least("tokens", F.greatest(F.col("partial") - (F.col("end") - F.col("tokens")), F.lit(0)))
    placed = placed.withColumn("taken", F.col("epochs") * F.col("tokens") + reach)
    taken = placed.where("taken > 0").select("doc_id", "text_key", *LEVELS, "tokens", "epochs", "taken")
    fits = placed.where("end <= partial").groupBy(*LEVELS).agg(F.max(F.struct("hash", "doc_id", "text_key")).alias("last"))
    return taken, given.join(fits, list(LEVELS), "left")


def order_hash(seed: int) -> Column:
    """The order of a leaf's documents in its last epoch, whose number is in ``epochs``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))


def small(leaves: DataFrame) -> DataFrame:
    """The table of leaves, to be broadcast if it is small."""
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def whole_documents(docs: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that fit whole into one epoch of their leaf; only the table of leaves moves."""
    keyed = leaves.select(*(F.col(c).alias(f"leaf_{c}") for c in LEVELS), "epochs", "last")
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"leaf_{c}") for c in LEVELS]
    joined = docs.join(small(saved(keyed)), same)
    key = F.struct(order_hash(seed).alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    holds = (count_tokens(F.col("text")) > 0) & ((F.col("epochs") > 0) | F.coalesce(key <= F.col("last"), F.lit(False)))
    return joined.where(holds).select(*(docs[c] for c in docs.columns))


#: Production parameters of the registered query.
WEIGHTS = {"domain": {"a": 4, "b": 3, "c": 2, "d": 1}, "lang": {"en": 5, "de": 3, "fr": 3, "es": 2}}
BUDGET_SHARE = 0.6


def domain_of(source: Column) -> Column:
    """The tables have no domains: sources are dealt to four by a hash of their names."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "4", "a").when(digit < "8", "b").when(digit < "c", "c").otherwise("d")


def _oracle_level(depth: int) -> str:
    path = ["domain", "lang", "source"][: depth + 1]
    keys, above, level = ", ".join(path), ", ".join(path[:-1]), path[-1]
    weight = {"domain": "case domain when 'a' then 4 when 'b' then 3 when 'c' then 2 else 1 end", "lang": "case lang when 'en' then 5 when 'de' then 3 when 'fr' then 3 when 'es' then 2 else 1 end", "source": "1"}[level]
    join = f"join level{depth - 1} p using ({above})" if depth else "cross join (select cast(floor(sum(tokens) * 0.6) as bigint) as share from leaves) p"
    by = f"partition by {above}" if depth else ""
    order = f"{by} order by capacity / weight, {level}"
    return f"""
  nodes{depth} as (
    select {keys}, sum(n.tokens) * 4 as capacity, {weight} as weight, any_value(p.share) as budget
    from leaves n {join} group by {keys} having sum(n.tokens) > 0),
  ranked{depth} as (
    select *, row_number() over ({order}) as place,
      capacity * sum(weight) over ({order} rows between current row and unbounded following)
        <= (budget - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0)) * weight as fits
    from nodes{depth}),
  filled{depth} as (
    select *, place < coalesce(min(place) filter (not fits) over ({by}), 1000000000) as is_full from ranked{depth}),
  parts{depth} as (
    select *, budget - coalesce(sum(capacity) filter (is_full) over ({by}), 0) as rest, sum(weight) filter (not is_full) over ({by}) as among from filled{depth}),
  split{depth} as (
    select *, (rest * weight) // among as part, place - count(*) filter (is_full) over ({by}) as nth from parts{depth}),
  level{depth} as (
    select {keys}, cast(case when is_full then capacity
      else part + case when nth <= rest - sum(part) filter (not is_full) over ({by}) then 1 else 0 end end as bigint) as share
    from split{depth} qualify share > 0)"""


ORACLE_SQL = f"""
with docs as (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
      case when left(md5(coalesce(source, '')), 1) < '4' then 'a' when left(md5(coalesce(source, '')), 1) < '8' then 'b'
        when left(md5(coalesce(source, '')), 1) < 'c' then 'c' else 'd' end as domain,
      coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) as tokens
    from documents),
  leaves as (select domain, lang, source, sum(tokens) as tokens from docs group by all),
  {_oracle_level(0)}, {_oracle_level(1)}, {_oracle_level(2)},
  given as (
    select l.domain, l.lang, l.source, g.share // l.tokens as epochs, g.share % l.tokens as partial
    from leaves l join level2 g using (domain, lang, source)),
  placed as (
    select d.*, g.epochs, g.partial,
      sum(d.tokens) over (partition by d.domain, d.lang, d.source
        order by md5(concat_ws('|', '7', cast(cast(g.epochs as bigint) as varchar), cast(d.doc_id as varchar))), d.doc_id rows unbounded preceding) - d.tokens as start
    from docs d join given g using (domain, lang, source)),
  taken as (
    select doc_id, domain, lang, source, cast(tokens as bigint) as tokens, cast(epochs as bigint) as epochs,
      cast(epochs * tokens + least(tokens, greatest(partial - start, 0)) as bigint) as taken
    from placed)
select * from taken where taken > 0
"""
