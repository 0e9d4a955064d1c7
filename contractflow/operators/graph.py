"""Events as RDF triples, N-Triples text, and contract checks on triples.

Every event is its own graph, named by its arrival position; all work is keyed by graph and node,
so it spreads evenly whatever users or tracks the events mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.contract import Constraint, Contract
from contractflow.functions.text import escape_literal, event_key, iri_part, lit, names
from contractflow.operators.checks import ValueOf, datatype_holds
from contractflow.operators.fence import fenced

# Standard vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"

DEFAULT_BASE = "http://example.org/"

TRIPLE_TYPE = "array<struct<s:string,p:string,o:string,o_kind:string,datatype:string>>"


def vocabulary(base: str = DEFAULT_BASE) -> str:
    return f"{base}ontology#"


def _triple(s: str, p: str, o: str, kind: str, datatype: str | None = None) -> str:
    return (
        f"if({o} is null, null, named_struct('s', {s}, 'p', {lit(p)}, 'o', {o}, "
        f"'o_kind', {lit(kind)}, 'datatype', {lit(datatype)}))"
    )


def triples_of(contract: Contract, value_of: ValueOf, fallback_id: str, base: str = DEFAULT_BASE) -> str:
    """The triples of one event; fields without a value are left out, the root node never is."""
    ns = vocabulary(base)
    root_field = next(f for f in contract.fields if f.node_class == contract.root_class)
    root = f"concat({lit(f'{base}event/')}, {iri_part(event_key(value_of(root_field.name), fallback_id))})"
    declared = {(c.target_class, c.path): c.value for c in contract.constraints if c.constraint == "datatype"}
    out = [_triple(root, RDF_TYPE, lit(ns + contract.root_class), "iri")]
    for f in contract.fields:
        value = value_of(f.name)
        datatype = XSD + declared.get((f.node_class, f.path), "string")
        if f.node_class == contract.root_class:
            out.append(_triple(root, ns + f.path, value, "literal", datatype))
        else:
            node = f"concat({lit(f'{base}{f.node_class.lower()}/')}, {iri_part(value)})"
            out.append(_triple(root, ns + f.link_path, node, "iri"))
            out.append(_triple(node, RDF_TYPE, f"if({value} is null, null, {lit(ns + f.node_class)})", "iri"))
            out.append(_triple(node, ns + f.path, value, "literal", datatype))
    return f"cast(array_compact(array({', '.join(out)})) as {TRIPLE_TYPE})"


def to_triples(
    events: DataFrame, contract: Contract, value_of: ValueOf, base: str = DEFAULT_BASE, keep: list[str] | None = None
) -> DataFrame:
    """``s, p, o, o_kind, datatype`` of every event next to the ``keep`` columns."""
    keep = ["ord"] if keep is None else keep
    return events.selectExpr(*keep, f"inline({triples_of(contract, value_of, 'fallback_id', base)})")


def ntriples_line() -> str:
    """One triple as an N-Triples line; plain strings carry no datatype."""
    literal = f"""concat('"', {escape_literal('o')}, '"')"""
    plain = f"datatype is null or datatype = {lit(XSD + 'string')}"
    target = (
        f"case when o_kind = 'iri' then concat('<', o, '>') when {plain} then {literal} "
        f"else concat({literal}, '^^<', datatype, '>') end"
    )
    return f"concat('<', s, '> <', p, '> ', {target}, ' .')"


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.selectExpr(f"{ntriples_line()} as value")


def export_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    ntriples(triples).write.mode(mode).text(path)


def path_counts(triples: DataFrame, graph: str = "ord") -> DataFrame:
    """Number of values per graph, node and path."""
    return triples.where(F.col("p") != RDF_TYPE).groupBy(graph, "s", "p").agg(F.count("*").alias("n"))


def _valued(contract: Contract) -> list[Constraint]:
    return [c for c in contract.constraints if c.constraint not in ("class", "node")]


def _linked(contract: Contract) -> list[Constraint]:
    return [c for c in contract.constraints if c.constraint in ("class", "node")]


def node_facts(triples: DataFrame, contract: Contract, base: str = DEFAULT_BASE, graph: str = "ord") -> DataFrame:
    """Per (graph, node): its classes, and how many values and faulty values each path has.

    Counts and flags only, so partial aggregation applies before the shuffle.  The facts are pinned
    as a whole: every use then asks for the same columns and the shuffle is done once.
    """
    ns = vocabulary(base)
    facts: dict[str, str] = {}
    linked = _linked(contract)
    classes = sorted({c.target_class for c in contract.constraints} | {c.value for c in linked if c.constraint == "class"})
    for cls in classes:
        facts[f"is_{cls}"] = f"max(if(p = {lit(RDF_TYPE)} and o = {lit(ns + cls)}, 1, 0))"
    for c in _valued(contract):
        on_path = f"p = {lit(ns + c.path)}"
        if c.constraint in ("minCount", "maxCount"):
            facts[f"count_{c.path}"] = f"count_if({on_path})"
        elif c.constraint == "minLength":
            facts[f"minLength_{c.shape}_{c.path}"] = f"count_if({on_path} and char_length(o) < {int(c.value)})"
        else:
            right = f"o_kind = 'literal' and datatype = {lit(XSD + c.value)} and {datatype_holds('o', c.value)}"
            facts[f"datatype_{c.shape}_{c.path}"] = f"count_if({on_path} and not coalesce({right}, false))"
    nodes = triples.groupBy(graph, "s").agg(*[F.expr(f"{e} as `{name}`") for name, e in facts.items()])
    return fenced(nodes, {name: f"`{name}`" for name in facts})


def graph_violations(
    triples: DataFrame, contract: Contract, base: str = DEFAULT_BASE, graph: str = "ord", deduplicate: bool = False
) -> DataFrame:
    """Report over triples: ``graph, shape, focus, path, constraint``.

    A graph is a set of triples; :func:`to_triples` repeats none, other inputs that may should set
    ``deduplicate``.

    Value constraints are read off :func:`node_facts`; links are then checked against the class
    and the own result of the node they lead to.
    """
    unique = triples.select(graph, "s", "p", "o", "o_kind", "datatype")
    if deduplicate:
        unique = unique.distinct()
    return _report(unique, node_facts(unique, contract, base, graph), contract, base, graph)


def _report(unique: DataFrame, nodes: DataFrame, contract: Contract, base: str, graph: str) -> DataFrame:
    ns = vocabulary(base)
    valued, linked = _valued(contract), _linked(contract)

    def fails(c: Constraint) -> str:
        if c.constraint == "minCount":
            return f"`count_{c.path}` < {int(c.value)}"
        if c.constraint == "maxCount":
            return f"`count_{c.path}` > {int(c.value)}"
        return f"`{c.constraint}_{c.shape}_{c.path}` > 0"

    def report(tests: list[tuple[Constraint, str]]) -> str:
        rows = [
            f"if({test}, named_struct('shape', {lit(c.shape)}, 'path', {lit(c.path)}, 'constraint', {lit(c.constraint)}), null)"
            for c, test in tests
        ]
        return f"inline(array_compact(array({', '.join(rows)})))"

    columns = [graph, "shape", "focus", "path", "constraint"]
    own = nodes.selectExpr(
        graph, "s as focus", report([(c, f"`is_{c.target_class}` = 1 and {fails(c)}") for c in valued])
    ).select(columns)
    if not linked:
        return own

    def sound(c: Constraint) -> str:
        """Whether a node may stand at the far end of a link."""
        if c.constraint == "class":
            return f"`is_{c.value}` = 1"
        inner = [fails(v) for v in valued if v.shape == c.value]
        return f"not ({' or '.join(inner)})" if inner else "true"

    ends = nodes.selectExpr(graph, "s as o", *[f"{sound(c)} as __ok_{i}" for i, c in enumerate(linked)])
    owners = " or ".join(f"`is_{cls}` = 1" for cls in sorted({c.target_class for c in linked}))
    links = unique.where(f"p in ({names(sorted({ns + c.path for c in linked}))})").select(graph, "s", "p", "o")
    broken = (
        links.join(nodes.where(owners).select(graph, "s"), [graph, "s"], "left_semi")
        .join(ends, [graph, "o"], "left")
        .selectExpr(
            graph,
            "s as focus",
            report(
                [(c, f"p = {lit(ns + c.path)} and not coalesce(__ok_{i}, false)") for i, c in enumerate(linked)]
            ),
        )
        .select(columns)
    )
    return own.unionByName(broken)


def graph_conforms(
    triples: DataFrame, contract: Contract, base: str = DEFAULT_BASE, graph: str = "ord", deduplicate: bool = False
) -> DataFrame:
    """``graph, conforms`` for every graph that has triples."""
    unique = triples.select(graph, "s", "p", "o", "o_kind", "datatype")
    if deduplicate:
        unique = unique.distinct()
    nodes = node_facts(unique, contract, base, graph)
    faults = _report(unique, nodes, contract, base, graph).selectExpr(graph, "1 as bad")
    # one more aggregation instead of a join: graphs with and without faults meet in a union
    return (
        nodes.selectExpr(graph, "0 as bad")
        .unionByName(faults)
        .groupBy(graph)
        .agg(F.expr("max(bad) = 0 as conforms"))
    )
