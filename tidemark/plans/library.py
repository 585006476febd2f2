"""Queries over library tables: trees, pages, audits, rejects, resolution, coverage of derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import library
from tidemark.plans.bindings import table
from tidemark.sources import captures


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one parent table."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return regions.union(nations).union(customers)


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.tree_paths(_tree(spark, sf_dir)).select("node", "root", F.col("depth").cast("long").alias("depth"), F.array_join("path", "/").alias("path"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers point to others by a rule that closes cycles among the first of them."""
    size = F.lit(12)
    edges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") < 12, (F.col("c_custkey") + 1) % size).otherwise(F.expr("c_custkey div 2")).alias("parent"))
    return library.find_cycles(edges, 12)


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pages = turns.where("(conv_id + turn) % 9 > 0").select(F.col("conv_id").alias("scope"), (F.col("turn") * 2).alias("offset"), F.lit(2).alias("n"))
    total = turns.groupBy(F.col("conv_id").alias("scope")).agg((F.count("*") * 2).alias("total"))
    return library.page_coverage(pages.join(total, "scope"))


def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    items = turns.select((F.col("conv_id") % 40).alias("scope"), F.expr("conv_id div 40").alias("page"), F.col("turn").alias("position"), F.md5(F.substring("text", 1, 3)).alias("remote_id"))
    return library.merge_pages(items, 3, 8)[1]


def audit_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return library.audit(
        {
            "order_without_customer": orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
            "line_without_order": lines.where("l_orderkey % 500 > 0").join(orders.where("o_orderkey % 100 > 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
            "repeated_line": lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
            "negative_balance": customers.where("c_acctbal < 0"),
        }
    )


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"title": F.trim("title") != "", "position": F.col("position") >= 0, "course": F.col("course") % 5 < 4}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("title"), (F.col("l_linenumber") - 2).alias("position"), F.col("l_suppkey").alias("course"))
    return library.validate(rows, rules)[1].select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


def list_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource_key"), "c_name")
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resource_key"), F.col("o_orderkey").alias("version_number"), "o_orderpriority")
    return library.list_materials(resources, versions)


def requested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resource_key"), F.col("o_orderkey").alias("version_number"), "o_orderpriority")
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("resource_key")).agg(F.min(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey"))).alias("version"))
    return library.get_resource(versions, wanted)


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, "part").when(F.col("l_linenumber") % 3 == 1, "supplier").otherwise("note").alias("kind"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("key"))
    tables = {"part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"))}
    return library.resolve_sources(refs, tables).select("l_orderkey", "l_linenumber", "kind", "key", "title")


def derivation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    inputs = docs.select(F.col("source").alias("course_key"), F.col("doc_id").alias("input_key"), F.md5("text").alias("content_hash"))
    done = docs.where("doc_id % 10 > 0").select(F.col("doc_id").alias("extraction_key"), F.md5("text").alias("content_hash"), F.when(F.col("doc_id") % 50 == 1, "PARTIAL").otherwise("COMPLETE").alias("coverage"))
    return library.derivation_coverage(inputs, done, docs.join(labels.where("toxic = 1"), "doc_id").select(F.col("source").alias("course_key")))


def api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("scope")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(" ")).alias("name"), F.col("role").alias("title")))).alias("results"))).alias("body"))
    found = captures.explode_api_pages(pages.withColumn("page", F.lit(0)), {"remote_id": ["id", "key"], "title": ["name", "title"]})
    return found.select("scope", F.col("position").cast("long").alias("position"), "remote_id", "title")


def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.col("html")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("%PDF-1.4 "), "url", F.when(F.col("page_id") % 8 == 1, "%%EOF").otherwise(""))).when(F.col("page_id") % 4 == 2, F.col("url")).otherwise(F.lit("")).cast("binary").alias("content"))
    return pages.select("page_id", captures.detect_format(F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256"))


QUERIES = [tree_paths, cycles, page_sequences, page_merge, audit_constraints, rejected_rows, list_materials, requested_versions, resolved_sources, derivation_coverage, api_rows, detected_formats]

ORACLE = {
    "tree_paths": """with recursive nodes as (
    select 'r' || r_regionkey as node, null as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
  walk as (select node, node as root, 0 as depth, node as path from nodes where parent is null
    union all select n.node, w.root, w.depth + 1, w.path || '/' || n.node from nodes n join walk w on n.parent = w.node)
select node, root, cast(depth as bigint) as depth, path from walk""",
    "cycles": "select cast(x as bigint) as node from range(1, 12) t(x) where x in (select c_custkey from customer) and not exists (select 1 from range(0, 12) u(y) where y not in (select c_custkey from customer)) union all select 0 where 0 in (select c_custkey from customer)",
    "page_sequences": """with t as (select conv_id as scope, count(*) * 2 as total from conversations group by 1),
  p as (select conv_id as scope, turn * 2 as off, lead(turn * 2) over (partition by conv_id order by turn) as next from conversations where (conv_id + turn) % 9 > 0)
select p.scope, count(*) as pages, case when bool_and(case when next is null then off + 2 >= total else next = off + 2 end) and min(off) = 0 then 'COMPLETE' else 'PARTIAL' end as coverage from p join t using (scope) group by 1""",
    "page_merge": """with i as (select conv_id % 40 as scope, conv_id // 40 as page, turn, md5(left(text, 3)) as id from conversations),
  r as (select *, row_number() over (partition by scope, id order by page, turn) as nth, dense_rank() over (partition by scope order by page) as pn from i),
  k as (select scope, least(count(*), 8) as kept from r where nth = 1 and pn <= 3 group by 1),
  s as (select scope, count(*) as seen, count(*) filter (nth > 1) as duplicates, max(pn) as pages from r group by 1)
select scope, seen, coalesce(kept, 0) as kept, duplicates, case when duplicates > 0 or pages > 3 or seen - duplicates > coalesce(kept, 0) then 'PARTIAL' else 'COMPLETE' end as coverage from s left join k using (scope)""",
    "audit_constraints": """select 'order_without_customer' as rule, count(*) as violations from orders where o_custkey not in (select c_custkey from customer)
union all select 'line_without_order', count(*) from lineitem where l_orderkey % 500 > 0 and l_orderkey not in (select o_orderkey from orders where o_orderkey % 100 > 0)
union all select 'repeated_line', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'negative_balance', count(*) from customer where c_acctbal < 0""",
    "rejected_rows": """select * from (select l_orderkey, l_linenumber, concat_ws(',', case when l_returnflag = 'R' then 'title' end, case when l_linenumber < 2 then 'position' end, case when l_suppkey % 5 = 4 then 'course' end) as reasons from lineitem) where reasons <> ''""",
    "list_materials": "select c_custkey as resource_key, c_name, max(o_orderkey) as version_number, arg_max(o_orderpriority, o_orderkey) as o_orderpriority from customer left join orders on o_custkey = c_custkey group by 1, 2",
    "requested_versions": """with w as (select o_custkey, min(case when o_orderkey % 10 = 0 then o_orderkey end) as v from orders where o_orderkey % 5 = 0 group by 1), n as (select o_custkey, max(o_orderkey) as m from orders group by 1)
select o.o_custkey as resource_key, o.o_orderkey as version_number, o_orderpriority from orders o join w using (o_custkey) join n using (o_custkey) where o.o_orderkey = coalesce(v, m)""",
    "resolved_sources": """select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'part' when 1 then 'supplier' else 'note' end as kind, case when l_linenumber % 3 = 0 then l_partkey else l_suppkey end as key,
  case l_linenumber % 3 when 0 then p_name when 1 then s_name end as title from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey""",
    "derivation_coverage": """with e as (select md5(text) as h, arg_max(case when doc_id % 50 = 1 then 'PARTIAL' else 'COMPLETE' end, doc_id) as coverage from documents where doc_id % 10 > 0 group by 1),
  u as (select source, count(*) as n from documents join labels using (doc_id) where toxic = 1 group by 1)
select d.source as course_key, count(*) as inputs, count(*) filter (coverage = 'COMPLETE') as complete, coalesce(any_value(n), 0) as unresolved,
  case when count(*) = count(*) filter (coverage = 'COMPLETE') and coalesce(any_value(n), 0) = 0 then 'COMPLETE' else 'PARTIAL' end as coverage
from documents d left join e on h = md5(d.text) left join u on u.source = d.source group by 1""",
    "api_rows": "select conv_id as scope, row_number() over (partition by conv_id order by cast(turn as varchar)) - 1 as position, cast(turn as varchar) as remote_id, role as title from conversations",
    "detected_formats": """with p as (select page_id, case page_id % 4 when 0 then html when 1 then '%PDF-1.4 ' || url || case when page_id % 8 = 1 then '%%EOF' else '' end when 2 then url else '' end as t from pages)
select page_id, case page_id % 4 when 0 then 'rejected:markup' when 1 then case when page_id % 8 = 1 then 'pdf' else 'rejected:truncated_pdf' end when 2 then 'text' else 'rejected:empty' end as format, sha256(t) as sha256 from p""",
}
