"""A catalog over the test tables, and its checks."""

from __future__ import annotations

from velarium.plans.model import Attribute as A
from velarium.plans.model import Catalog, Object, Relation

NUMBERS = ("AMOUNT", "NUMBER", "RATIO")
COUNT_ONLY = ("TEXT", "CODE", "ENUM", "ID", "FOREIGN_KEY")


def _object(code: str, table: str, kind: str, key: tuple[str, ...], time: str, *attributes: A) -> Object:
    return Object(code, table, kind, key, attributes, time)


STAR = Catalog(
    objects={
        o.code: o
        for o in (
            _object("sales_line", "lineitem", "EVENT", ("l_orderkey", "l_linenumber"), "l_shipdate", A("l_orderkey", "FOREIGN_KEY"), A("l_partkey", "FOREIGN_KEY"), A("l_suppkey", "FOREIGN_KEY"), A("l_linenumber", "ID"), A("l_quantity", "NUMBER"), A("l_extendedprice", "AMOUNT"), A("l_discount", "RATIO", additivity="none"), A("l_tax", "RATIO", additivity="none"), A("l_returnflag", "ENUM"), A("l_linestatus", "ENUM"), A("l_shipdate", "DATETIME"), A("revenue", "AMOUNT", transform="l_extendedprice * (1 - l_discount)"), A("over_half", "AMOUNT", transform="greatest(l_quantity - 25, 0D)")),
            _object("order", "orders", "EVENT", ("o_orderkey",), "o_orderdate", A("o_orderkey", "ID"), A("o_custkey", "FOREIGN_KEY"), A("o_orderstatus", "ENUM"), A("o_totalprice", "AMOUNT"), A("o_orderdate", "DATETIME"), A("o_orderpriority", "ENUM")),
            _object("activity", "events", "EVENT", ("event_id",), "ts", A("event_id", "ID"), A("user_id", "FOREIGN_KEY"), A("event_type", "ENUM"), A("value", "NUMBER"), A("ts", "DATETIME")),
            _object("customer", "customer", "ENTITY", ("c_custkey",), "", A("c_custkey", "ID"), A("c_name"), A("c_nationkey", "FOREIGN_KEY"), A("c_acctbal", "AMOUNT", additivity="semi"), A("c_mktsegment", "ENUM")),
            _object("supplier", "supplier", "ENTITY", ("s_suppkey",), "", A("s_suppkey", "ID"), A("s_name"), A("s_nationkey", "FOREIGN_KEY"), A("s_acctbal", "AMOUNT", additivity="semi")),
            _object("part", "part", "ENTITY", ("p_partkey",), "", A("p_partkey", "ID"), A("p_name"), A("p_brand", "ENUM"), A("p_type", "ENUM"), A("p_size", "NUMBER"), A("p_retailprice", "AMOUNT")),
            _object("nation", "nation", "ENTITY", ("n_nationkey",), "", A("n_nationkey", "ID"), A("n_name"), A("n_regionkey", "FOREIGN_KEY")),
            _object("region", "region", "ENTITY", ("r_regionkey",), "", A("r_regionkey", "ID"), A("r_name")),
        )
    },
    relations=(
        Relation("line_order", "sales_line", "order", (("l_orderkey", "o_orderkey"),), required=True),
        Relation("line_part", "sales_line", "part", (("l_partkey", "p_partkey"),)),
        Relation("line_supplier", "sales_line", "supplier", (("l_suppkey", "s_suppkey"),)),
        Relation("order_customer", "order", "customer", (("o_custkey", "c_custkey"),), required=True),
        Relation("customer_nation", "customer", "nation", (("c_nationkey", "n_nationkey"),)),
        Relation("supplier_nation", "supplier", "nation", (("s_nationkey", "n_nationkey"),), priority=2, role="supplier_nation"),
        Relation("nation_region", "nation", "region", (("n_regionkey", "r_regionkey"),)),
    ),
)


def legal_operators(attribute: A) -> tuple[str, ...]:
    """Text, codes and ids can only be counted; what isn't additive can't be summed, or only within what keeps it apart."""
    if attribute.semantic_type in COUNT_ONLY:
        return ("COUNT", "COUNT_DISTINCT")
    out = ("COUNT", "COUNT_DISTINCT", "AVG", "MAX", "MIN", "MEDIAN")
    return (*out, "SUM") if (attribute.additivity != "none" or attribute.within) and attribute.semantic_type in NUMBERS else out
