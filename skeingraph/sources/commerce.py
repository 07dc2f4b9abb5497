"""The contract of the commerce, event and document tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeingraph.functions.canonical import hashed
from skeingraph.plans.catalog import Catalog, Fact, Field, Owner, long_text, number, reference, text
from skeingraph.sources.tables import table


def _ref(owner: str, key: str) -> Column:
    return F.when(F.col(key).isNotNull(), F.concat(F.lit(f"{owner}:"), F.col(key).cast("string")))


def _reader(source: str, key: str, /, **columns: str):
    """columns: SQL expressions over the table, made columns only when it is read."""

    def read(spark, folder) -> DataFrame:
        return table(spark, folder, source).select(F.col(key).cast("long").alias("id"), *[F.expr(c).alias(n) for n, c in columns.items()])

    return read


def _to(owner: str, key: str) -> str:
    return f"if({key} is not null, concat('{owner}:', {key}), null)"


def _line_items(spark, folder) -> DataFrame:
    items = table(spark, folder, "lineitem")
    rows = items.select(_ref("order", "l_orderkey").alias("order"), _ref("part", "l_partkey").alias("part"), _ref("supplier", "l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return hashed(rows, ["order", "part", "supplier"], ["quantity", "extendedprice", "discount", "returnflag", "linestatus"])


def _pairs(name: str, key: str, role: str, other_key: str, other_role: str):
    def read(spark, folder) -> DataFrame:
        rows = table(spark, folder, name).select(_ref(role, key).alias(role), _ref(other_role, other_key).alias(other_role))
        return hashed(rows, [role, other_role], [])

    return read


def _bought(spark, folder) -> DataFrame:
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_ref("customer", "o_custkey").alias("customer"), _ref("part", "l_partkey").alias("part"), F.col("l_returnflag").alias("returnflag"))
    return hashed(rows, ["customer", "part"], ["returnflag"])


def _supplied(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(_ref("supplier", "l_suppkey").alias("supplier"), _ref("part", "l_partkey").alias("part"))
    return hashed(rows, ["supplier", "part"], [])


def _parts(spark, folder) -> DataFrame:
    own = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"))
    flags = table(spark, folder, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), F.col("n").alias("count")))).alias("flags"))
    return own.join(flags, F.col("id") == F.col("l_partkey"), "left").drop("l_partkey")


def _suppliers(spark, folder) -> DataFrame:
    own = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), _ref("nation", "s_nationkey").alias("nationRef"), F.col("s_acctbal").alias("acctbal"))
    brands = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    return own.join(brands, F.col("id") == F.col("l_suppkey"), "left").drop("l_suppkey")


#: Priority codes and status labels.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = {"F": "finished", "O": "open"}

CATALOG = Catalog(
    owners={
        "region": Owner({"name": text("lookup")}, _reader("region", "r_regionkey", name="r_name")),
        "nation": Owner({"name": text("lookup"), "regionRef": reference("region")}, _reader("nation", "n_nationkey", name="n_name", regionRef=_to("region", "n_regionkey"))),
        "customer": Owner({"name": text("lookup"), "nationRef": reference("nation"), "acctbal": number(), "balance": number(), "segment": text()}, _reader("customer", "c_custkey", name="c_name", nationRef=_to("nation", "c_nationkey"), acctbal="c_acctbal", balance="if(c_acctbal >= 0, c_acctbal, null)", segment="c_mktsegment")),
        "supplier": Owner({"name": text("lookup"), "nationRef": reference("nation"), "acctbal": number(), "brands": Field("string[]", "list")}, _suppliers),
        "part": Owner({"name": text("lookup", "fullText"), "brand": text(), "kind": text(), "size": number("integer"), "price": number(), "flags": Field("tag[]", "tagList")}, _parts),
        "order": Owner({"customerRef": reference("customer"), "status": text(enum="status"), "openStatus": text(), "total": number(), "date": Field("string", "ordered"), "priority": text(enum="priority")}, _reader("orders", "o_orderkey", customerRef=_to("customer", "o_custkey"), status="o_orderstatus", openStatus="nullif(o_orderstatus, 'F')", total="o_totalprice", date="date_format(o_orderdate, 'yyyy-MM-dd')", priority="o_orderpriority")),
        "event": Owner({"customerRef": reference("customer"), "kind": text(), "value": number()}, _reader("events", "event_id", customerRef=_to("customer", "user_id"), kind="event_type", value="value"), traversable=False, order=("customerRef", "kind", "value")),
        "document": Owner({"text": long_text(), "lang": text(), "source": text(), "length": number("integer")}, _reader("documents", "doc_id", text="text", lang="lang", source="source", length="n_chars")),
        "page": Owner({"url": text("lookup"), "html": long_text()}, _reader("pages", "page_id", url="url", html="html")),
    },
    facts={
        "LINE_ITEM": Fact({"order": "order", "part": "part", "supplier": "supplier"}, _line_items, {"quantity": number(), "extendedprice": number(), "discount": number(), "returnflag": text("fullText"), "linestatus": text()}),
        "PLACED": Fact({"customer": "customer", "order": "order"}, _pairs("orders", "o_custkey", "customer", "o_orderkey", "order")),
        "LOCATED": Fact({"customer": "customer", "nation": "nation"}, _pairs("customer", "c_custkey", "customer", "c_nationkey", "nation")),
        "BASED": Fact({"supplier": "supplier", "nation": "nation"}, _pairs("supplier", "s_suppkey", "supplier", "s_nationkey", "nation")),
        "WITHIN": Fact({"nation": "nation", "region": "region"}, _pairs("nation", "n_nationkey", "nation", "n_regionkey", "region")),
        "BOUGHT": Fact({"customer": "customer", "part": "part"}, _bought, {"returnflag": text()}),
        "SUPPLIED": Fact({"supplier": "supplier", "part": "part"}, _supplied),
    },
)
