"""Logbooks, flows and atoms: assembling, merging, deleting; dependency resolution; sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import _grown, cut, shuffled, stored
from .subgraphs import satisfied

def assemble_logbooks(books: DataFrame, flows: DataFrame, atoms: DataFrame, lazy: bool = False) -> DataFrame:
    """One nested row for each book; books without flows and flows without atoms are kept.

    Atoms are nested by flow before they meet the flows, so each level shuffles once.
    """
    if lazy:
        return books
    nested = atoms.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "state"))).alias("atoms"))
    full = flows.join(nested, flows["uuid"] == nested["flow"], "left").select("parent_uuid", F.struct(F.col("uuid"), F.col("state"), F.coalesce("atoms", F.array().cast(nested.schema["atoms"].dataType)).alias("atoms")).alias("f"))
    per_book = full.groupBy("parent_uuid").agg(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["uuid"] < b["uuid"], -1).when(a["uuid"] > b["uuid"], 1).otherwise(0)).alias("flows"))
    return books.join(per_book, books["uuid"] == per_book["parent_uuid"], "left").select("uuid", "name", F.coalesce("flows", F.array().cast(per_book.schema["flows"].dataType)).alias("flows"))


def merge_history(base: DataFrame, incoming: DataFrame, order: str, replaced: list[str]) -> DataFrame:
    """Upsert by uuid: the latest incoming row replaces the listed columns; nothing is deleted."""
    last = incoming.groupBy("uuid").agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in ("uuid", order)]), order).alias("new"))
    both = base.join(last, "uuid", "full")
    columns = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.coalesce(F.col(c), F.col(f"new.{c}")).alias(c) for c in base.columns if c != "uuid"]
    return both.select("uuid", *columns)


def destroy_logbooks(books: DataFrame, flows: DataFrame, atoms: DataFrame, uuids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(books, flows, atoms) that stay, and the uuids that no book has."""
    gone = flows.join(uuids.withColumnRenamed("uuid", "parent_uuid"), "parent_uuid", "left_semi").select(F.col("uuid").alias("flow"))
    left = books.join(uuids, "uuid", "left_anti"), flows.join(uuids.withColumnRenamed("uuid", "parent_uuid"), "parent_uuid", "left_anti")
    return (*left, atoms.join(gone, "flow", "left_anti"), uuids.join(books, "uuid", "left_anti"))


def resolve_dependencies(provides: DataFrame, requires: DataFrame) -> DataFrame:
    """(flow, src, dst, reasons): from the provider of a symbol to each that requires it.

    All at once and free of order: a symbol with several providers is linked to nobody.
    Providers are counted per (flow, name) before the join, so no pairs of providers arise.
    """
    one = provides.groupBy("flow", "name").agg(F.countDistinct("atom").alias("many"), F.min("atom").alias("src"))
    linked = requires.join(one.where("many = 1"), ["flow", "name"]).where(F.col("src") != F.col("atom"))
    return linked.groupBy("flow", "src", F.col("atom").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("reasons"))


def symbol_status(provides: DataFrame, requires: DataFrame) -> DataFrame:
    """LINKED, AMBIGUOUS or UNSATISFIED for every required symbol."""
    one = provides.groupBy("flow", "name").agg(F.countDistinct("atom").alias("many"))
    status = F.when(F.col("many").isNull(), "UNSATISFIED").when(F.col("many") > 1, "AMBIGUOUS").otherwise("LINKED")
    return requires.join(one, ["flow", "name"], "left").groupBy("flow", "name").agg(F.min(status).alias("status"), F.count("*").alias("n"))


def unsatisfied_linear(provides: DataFrame, requires: DataFrame) -> DataFrame:
    """Linear flow: required symbols that no earlier item provides.

    Only the first provider of a symbol matters, so the earlier-than test is an equi-join.
    """
    first = provides.groupBy("flow", "name").agg(F.min("atom").alias("first"))
    return requires.join(first, ["flow", "name"], "left").where(F.col("first").isNull() | (F.col("first") >= F.col("atom"))).select("flow", "atom", "name")


def fetch_symbols(provides: DataFrame) -> DataFrame:
    """symbol -> value of its first provider, and how many there are."""
    return provides.groupBy("flow", "name").agg(F.min("atom").alias("value"), F.count("*").alias("providers"))


def resolve_arguments(candidates: DataFrame) -> DataFrame:
    """Of the candidates (flow, arg, precedence, pos, value) of every argument the first."""
    return candidates.groupBy("flow", "arg").agg(F.min_by(F.struct("precedence", "value"), F.struct("precedence", "pos")).alias("c")).select("flow", "arg", "c.precedence", "c.value")


def missing_arguments(requires: DataFrame, provides: DataFrame, injected: DataFrame) -> DataFrame:
    """Bound arguments without any potential provider, as a sorted list for each flow."""
    known = provides.select("flow", "name").unionByName(injected.select("flow", "name")).distinct()
    return requires.join(known, ["flow", "name"], "left_anti").groupBy("flow").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("missing"))


# The columns that an update replaces, by level.
REPLACED = {
    "book": ["meta", "created_at", "updated_at"],
    "flow": ["meta", "state"],
    "atom": ["state", "intention", "failure", "revert_failure", "meta", "version", "results", "revert_results"],
}


def merge_level(base: DataFrame, incoming: DataFrame, level: str, order: str, parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected) of one level of the history, by uuid: merge_history() with the level's own columns.

    parents: (uuid) of the level above; incoming rows whose parent_uuid isn't among them are
    rejected with the problem NOT_FOUND and change nothing.
    """
    rejected = incoming.where("false").withColumn("problem", F.lit("NOT_FOUND"))
    if parents is not None:
        known = parents.select(F.col("uuid").alias("parent_uuid")).distinct()
        rejected = incoming.join(known, "parent_uuid", "left_anti").withColumn("problem", F.lit("NOT_FOUND")).select(*incoming.columns, "problem")
        incoming = incoming.join(known, "parent_uuid", "left_semi").select(*incoming.columns)
    return merge_history(base, incoming, order, [c for c in REPLACED[level] if c in incoming.columns]), rejected


def link_atoms(provides: DataFrame, requires: DataFrame, manual: DataFrame | None = None, retry_provides: DataFrame | None = None) -> DataFrame:
    """(flow, src, dst, reasons, manual): resolve_dependencies() with links made by hand (flow, src, dst).

    What a flow's retry provides (flow, name) needs no link. A link by hand that is also one by
    symbols keeps its reasons.
    """
    if retry_provides is not None:
        requires = requires.join(retry_provides.select("flow", "name"), ["flow", "name"], "left_anti")
    found = resolve_dependencies(provides, requires).withColumn("manual", F.lit(False))
    if manual is not None:
        found = found.unionByName(manual.select("flow", "src", "dst", F.lit("").alias("reasons"), F.lit(True).alias("manual")))
    return found.groupBy("flow", "src", "dst").agg(F.max("reasons").alias("reasons"), F.max("manual").alias("manual"))


def unsatisfied_requires(pairs: DataFrame, provides: DataFrame, requires: DataFrame, retry_provides: DataFrame) -> DataFrame:
    """(flow, atom, name): required symbols that neither the flow's retry nor any ancestor provides.

    pairs: (start, node) from ancestors(). The distinct names by flow are what it needs from outside.
    """
    open_ = requires.join(retry_provides.select("flow", "name"), ["flow", "name"], "left_anti")
    given = pairs.join(provides.select(F.col("atom").alias("node"), "name"), "node").select(F.col("start").alias("atom"), "name").distinct()
    return open_.join(given, ["atom", "name"], "left_anti").select("flow", "atom", "name").distinct()


def unsatisfied_on_demand(edges: DataFrame, provides: DataFrame, requires: DataFrame, retry_provides: DataFrame) -> DataFrame:
    """unsatisfied_requires() from the edges (src, dst), without pairs of nodes and their ancestors.

    Tasks find it in the edges of all that a part of the atoms has before it (see subgraphs). What a part with too many of
    them wants is found by rounds.
    """
    open_ = stored(requires.join(retry_provides.select("flow", "name"), ["flow", "name"], "left_anti").select("flow", "atom", "name").distinct())
    known = lambda df: df.select(F.col("atom").alias("at"), "name").where("at IS NOT NULL AND name IS NOT NULL").distinct()
    given, wanted = stored(known(provides)), stored(known(open_))
    before = stored(edges.select(F.col("dst").alias("at"), F.col("src").alias("node")).where("at <> node").distinct().withColumns({"open": F.lit(True), "shown": F.lit(True)}))
    found, left = satisfied(before, given, wanted)
    found = found if left is None else found.unionByName(_satisfied_by_rounds(before, given, left))
    return open_.join(shuffled(found.withColumnRenamed("at", "atom")), ["atom", "name"], "left_anti").select("flow", "atom", "name")


def _satisfied_by_rounds(before: DataFrame, given: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (at, name) of wanted that another node before `at`, by steps (at, node), has in given.

    What an atom wants is walked backward as labels (symbol, node), each once however many atoms
    want it, and no further than to a node that provides it; from there the answer comes back
    along the labels. Only what an atom both wants and provides keeps the atom in its label, since
    on a cycle the atom isn't its own provider.
    """
    origin = F.when(F.col("own"), F.col("at"))
    wanted = wanted.join(given.withColumn("own", F.lit(True)), ["at", "name"], "left")
    wanted = cut(wanted.select("name", "at", origin.alias("origin"), F.to_json(F.struct("name", origin.alias("origin"))).alias("label")))
    before = cut(before.select("at", F.col("node").alias("to")))
    walked = cut(wanted.select("label", "name", "origin", "at", F.lit(False).alias("hit")).distinct())  # these are never hits
    frontier, rounds = walked, 0
    while True:
        rounds += 1
        step = frontier.join(shuffled(before), "at").select("label", "name", "origin", F.col("to").alias("at")).distinct()
        step = step.join(shuffled(walked.select("label", "at")), ["label", "at"], "left_anti").join(shuffled(given.withColumn("has", F.lit(True))), ["name", "at"], "left")
        hit = F.coalesce(F.col("has") & ~F.col("at").eqNullSafe(F.col("origin")), F.lit(False))
        step = cut(step.select("label", "name", "origin", "at", hit.alias("hit")))
        if step.isEmpty():
            break
        walked, frontier = _grown(walked, step, rounds), step.where("NOT hit")
    walked = cut(walked.select("label", "at", "hit"))
    after = before.select(F.col("to").alias("at"), F.col("at").alias("to"))
    labels, frontier, known, rounds = walked.where("NOT hit").select("label", "at"), walked.where("hit").select("label", "at"), None, 0
    while True:
        rounds += 1
        step = frontier.join(shuffled(after), "at").select("label", F.col("to").alias("at")).distinct().join(shuffled(labels), ["label", "at"], "left_semi")
        frontier = cut(step if known is None else step.join(shuffled(known), ["label", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        known = _grown(known, frontier, rounds)
    back = frontier if known is None else known
    return wanted.join(back, ["label", "at"], "left_semi").select("at", "name")


def missing_in_scopes(args: DataFrame, provides: DataFrame, injected: DataFrame, scopes: DataFrame) -> DataFrame:
    """(flow, method, missing): sorted names of bound arguments without any potential provider.

    args: (flow, atom, method, arg, name, optional); optional ones are never missing. provides:
    (flow, atom, name); injected: (flow, atom, name), a null atom for the whole flow;
    scopes: (flow, atom, visible). A provider counts if the atom sees it, whatever its state.
    """
    need = args.where(~F.coalesce("optional", F.lit(False)))
    need = need.join(injected.where("atom IS NULL").select("flow", "name"), ["flow", "name"], "left_anti")
    need = need.join(injected.where("atom IS NOT NULL").select("flow", "atom", "name"), ["flow", "atom", "name"], "left_anti")
    seen = scopes.select("flow", "atom", "visible").join(provides.select("flow", F.col("atom").alias("visible"), "name"), ["flow", "visible"]).select("flow", "atom", "name").distinct()
    left = need.join(seen, ["flow", "atom", "name"], "left_anti")
    return left.groupBy("flow", "method").agg(F.array_join(F.array_sort(F.collect_set("arg")), ",").alias("missing"))


def look_up_arguments(args: DataFrame, injected: DataFrame, inputs: DataFrame, provided: DataFrame, scopes: DataFrame) -> DataFrame:
    """(flow, atom, arg, status, source, value) of every bound argument (flow, atom, arg, name, optional).

    injected: (flow, atom, name, value, transient); inputs: (flow, name, value) of whole flows;
    provided: (flow, atom, name, status, value) with status IGNORED, NOT_KNOWN, RESULT or FAILURE
    of results_of(), a null value of a RESULT being one that hasn't the named part; scopes:
    (flow, atom, level, at, visible). What counts is, in this order: the atom's transient values,
    its persistent ones, the flow's inputs, and the nearest level of the scope that has a
    provider which isn't ignored. If one there hasn't finished the argument is NOT_FOUND, else
    the first that has the part gives it. An optional argument is OMITTED only if its name has
    no provider at all.
    """
    key = ["flow", "atom", "arg"]
    own = injected.groupBy("flow", "atom", "name").agg(F.min_by(F.struct("value", "transient"), ~F.col("transient")).alias("own"))
    inputs = inputs.groupBy("flow", "name").agg(F.first(F.struct("value")).alias("input"))
    registered = provided.select("flow", "name").distinct().withColumn("registered", F.lit(True))
    seen = args.select(*key, "name").join(provided.select("flow", F.col("atom").alias("visible"), "name", "status", "value"), ["flow", "name"]).join(scopes, ["flow", "atom", "visible"])
    seen = seen.where("status <> 'IGNORED'")
    usable = F.when((F.col("status") == "FAILURE") | F.col("value").isNotNull(), F.struct("at", "value"))
    levels = seen.groupBy(*key, "level").agg(F.max(F.col("status") == "NOT_KNOWN").alias("unfinished"), F.min(usable).alias("first"))
    nearest = levels.groupBy(*key).agg(F.min_by(F.struct("unfinished", "first"), "level").alias("scope"))
    all_ = args.join(own, ["flow", "atom", "name"], "left").join(inputs, ["flow", "name"], "left").join(registered, ["flow", "name"], "left").join(nearest, key, "left")
    found = F.coalesce(~F.col("scope.unfinished") & F.col("scope.first").isNotNull(), F.lit(False))
    source = (
        F.when(F.col("own").isNotNull(), F.when(F.col("own.transient"), "TRANSIENT").otherwise("PERSISTENT"))
        .when(F.col("input").isNotNull(), "INPUT").when(found, "SCOPE")
    )
    value = F.when(F.col("own").isNotNull(), F.col("own.value")).when(F.col("input").isNotNull(), F.col("input.value")).when(found, F.col("scope.first.value"))
    omitted = F.coalesce("optional", F.lit(False)) & F.col("registered").isNull()
    status = F.when(source.isNotNull(), "FOUND").when(omitted, "OMITTED").otherwise("NOT_FOUND")
    return all_.select(*key, status.alias("status"), source.alias("source"), value.alias("value"))


def fetch_all(provided: DataFrame, many: Callable[[Column], Column] | None = None) -> DataFrame:
    """(flow, name, status, value): the value of every provided name over all its providers.

    provided: (flow, pos, name, status, value) as for look_up_arguments(). Ignored providers are
    skipped; if one hasn't finished, one hasn't the part, or none is left, the name is NOT_FOUND.
    many: makes one value of the array of values, in the order of providers; the first by default.
    """
    status = F.col("status")
    useful = status != "IGNORED"
    bad = useful & ((status == "NOT_KNOWN") | ((status == "RESULT") & F.col("value").isNull()))
    values = F.transform(F.array_sort(F.filter(F.collect_list(F.when(useful, F.struct("pos", "value"))), lambda s: s.isNotNull())), lambda s: s["value"])
    by = provided.groupBy("flow", "name").agg(F.max(bad).alias("bad"), F.count_if(useful).alias("n"), values.alias("vals"))
    ok = ~F.col("bad") & (F.col("n") > 0)
    one = many or (lambda vals: F.get(vals, F.lit(0)))
    return by.select("flow", "name", F.when(ok, "FOUND").otherwise("NOT_FOUND").alias("status"), F.when(ok, one(F.col("vals"))).alias("value"))


# ---------------------------------------------------------------- sets
def sequence_minus(a: DataFrame, b: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Multiset difference in order: each item of b removes the earliest equal item of a."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(key, value).orderBy(pos)))
    return nth(a).join(nth(b).select(key, value, "nth"), [key, value, "nth"], "left_anti").drop("nth")


def array_minus(a: Column, b: Column) -> Column:
    """sequence_minus on arrays: keeps an item once it occurs more often than b removes it."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y.eqNullSafe(x)))
    return F.filter(a, lambda x, i: count(F.slice(a, F.lit(1), i + 1), x) > count(b, x))


def ordered_union(*sets: Column) -> Column:
    out = F.array_distinct(sets[0])
    for s in sets[1:]:
        out = F.array_union(out, s)
    return out


def ordered_intersection(*sets: Column) -> Column:
    out = F.array_distinct(sets[0])
    for s in sets[1:]:
        out = F.array_intersect(out, s)
    return out


def ordered_difference(*sets: Column) -> Column:
    out = F.array_distinct(sets[0])
    for s in sets[1:]:
        out = F.array_except(out, s)
    return out
