"""Named detectors over facts of source code; each gives findings (detector, subject, n, evidence).

A detector is a function (facts, modules, limits) -> DataFrame, registered under its own name by @detector.
Evidence is the first EVIDENCE places in order of path and line; n counts all of them and paths are those of all, so that a
scope is asked of every place.  Several detectors follow published descriptions of which only the title is known; they
state their own rule in the docstring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiberloom.functions import names
from fiberloom.functions.costs import certificate
from fiberloom.operators import classes as lineage
from fiberloom.operators import grouping, matching
from fiberloom.scratch import settle
from fiberloom.sources import code
from fiberloom.sources.code import family

EVIDENCE = 6
FINDINGS = "detector string, subject string, n long, evidence array<struct<path: string, line: long, symbol: string>>"
#: The published default of each threshold.
LIMITS = {
    "min_duplicate_statements": 3, "min_string_cases": 2, "min_attribute_probes": 2, "min_builder_keywords": 3, "min_export_keys": 3, "min_registration_sites": 2,
    "min_hardcoded_string_sites": 3, "min_unreferenced_private_function_lines": 8, "min_repeated_local_regex_literals": 3, "min_orchestration_function_lines": 150,
    "min_orchestration_branches": 15, "min_orchestration_calls": 50, "min_shared_parameters": 5, "min_parameter_family_function_lines": 40, "min_boundary_fanout_sites": 4,
    "min_branch_cluster_function_lines": 80, "min_branch_cluster_branches": 8, "min_role_bundle_fields": 3, "min_family_size": 3, "min_stage_sites": 3, "min_reflective_selector_values": 2, "min_literal_schema_field_count": 2, "min_literal_schema_owner_count": 2, "max_blank_lines": 4,
    "min_role_drift_use_sites": 2, "min_role_drift_token_support": 2, "min_generic_role_case_table_owners": 2, "min_generic_role_case_table_cases": 2, "min_local_role_case_logic_cases": 2,
}

DETECTORS: dict[str, Callable[[DataFrame, DataFrame, dict], DataFrame]] = {}


def detector(f):
    DETECTORS[f.__name__] = f
    return f


def symbol() -> Column:
    return F.concat_ws(".", F.nullif("owner", F.lit("")), F.nullif("func", F.lit("")), "name")


def place() -> Column:
    return F.struct("path", "line", symbol().alias("symbol"))


def grouped(rows: DataFrame, keys: list[Column], least: int, *more: Column, where: str = "true") -> DataFrame:
    """(subject, n, evidence, paths) of groups of at least ``least`` places; further aggregates may be asked for in ``where``.

    Only EVIDENCE places of a group are ever gathered; they are ranked in every task before they meet.
    """
    named = rows.withColumn("_subject", F.concat_ws(" | ", *[k.cast("string") for k in keys]))
    out = named.groupBy("_subject").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"), *more).where((F.col("n") >= least) & F.expr(where))
    nth = F.row_number().over(Window.partitionBy("_subject").orderBy("path", "line", "symbol"))
    first = named.select("_subject", "path", "line", symbol().alias("symbol")).withColumn("_nth", nth).where(F.col("_nth") <= EVIDENCE)
    first = first.groupBy("_subject").agg(F.array_sort(F.collect_list(F.struct("path", "line", "symbol"))).alias("evidence"))
    return out.join(first, "_subject").select(F.col("_subject").alias("subject"), "n", "evidence", "paths")


def single(rows: DataFrame) -> DataFrame:
    return rows.select(symbol().alias("subject"), F.lit(1).cast("long").alias("n"), F.array(place()).alias("evidence"))


def at_classes(facts: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """``found`` (subject, n, ...) with the places of the classes named in ``columns`` as evidence."""
    places = lineage.class_table(facts).groupBy("symbol").agg(F.min(F.struct("path", "line")).alias("_p"))
    for c in columns:
        found = found.join(places.select(F.col("symbol").alias(f"_of_{c}"), F.col("_p").alias(f"_at_{c}")), F.substring_index(c, "/", 1) == F.col(f"_of_{c}"), "left")
    spot = lambda c: F.struct(F.coalesce(f"_at_{c}.path", F.lit("")).alias("path"), F.coalesce(f"_at_{c}.line", F.lit(0)).alias("line"), F.col(c).alias("symbol"))
    return found.select("subject", "n", F.array(*map(spot, columns)).alias("evidence"))


def number(key: str) -> Column:
    return F.col("numbers")[key]


def owned(facts: DataFrame, kind: str) -> DataFrame:
    return family(facts, kind).withColumn("cls", F.concat_ws(".", "module", "owner"))


@detector
def repeated_method_shape(facts, modules, limits):
    """Methods of like bodies in two or more classes; public ones must share a name."""
    m = owned(facts, "method").where(number("statements") >= limits["min_duplicate_statements"])
    keys = [number("private"), F.size("items"), F.col("value")]
    return grouped(m, keys, 2, F.count_distinct("cls").alias("classes"), F.count_distinct("name").alias("names"), F.max(number("private")).alias("p"), where="classes >= 2 and (p = 1 or names = 1)")


@detector
def hierarchy_candidate(facts, modules, limits):
    """Classes that share two or more like methods."""
    m = owned(facts, "method").where(number("statements") >= limits["min_duplicate_statements"])
    sets = grouping.cohorts(m.withColumn("shape", F.concat_ws("/", "name", "value")), "cls", "shape", least_fibers=2)
    each = sets.select(F.col("witnesses").alias("subject"), F.col("n_witnesses").alias("n"), F.explode(F.split("witnesses", ",")).alias("symbol"))
    placed = each.join(lineage.class_table(facts).groupBy("symbol").agg(F.min("path").alias("path"), F.min("line").alias("line")), "symbol")
    return placed.groupBy("subject", "n").agg(F.array_sort(F.collect_list(F.struct("path", "line", "symbol"))).alias("evidence"))


@detector
def orchestration_hub(facts, modules, limits):
    """Functions of many lines, branches and calls."""
    big = (number("lines") >= limits["min_orchestration_function_lines"]) & (number("branches") >= limits["min_orchestration_branches"]) & (number("calls") >= limits["min_orchestration_calls"])
    return single(family(facts, "method", "function").where(big))


@detector
def parameter_thread_family(facts, modules, limits):
    """Pairs of functions that share many parameters, one of them long."""
    f = family(facts, "method", "function").withColumn("id", F.concat_ws(":", "path", "line", "name")).withColumn("long", number("lines") >= limits["min_parameter_family_function_lines"])
    atoms = f.select("id", "long", F.explode("items").alias("p")).where("p not in ('self', 'cls')")
    pairs = matching.overlap_pairs(atoms, "id", "p", limits["min_shared_parameters"])
    lengthy = atoms.groupBy("id").agg(F.max("long").alias("long"))
    some = pairs.join(lengthy.select(F.col("id").alias("left_id"), F.col("long").alias("a")), "left_id").join(lengthy.select(F.col("id").alias("right_id"), F.col("long").alias("b")), "right_id").where("a or b")
    return some.select(F.concat_ws(" | ", "left_id", "right_id").alias("subject"), F.col("n_shared").alias("n"), F.array(*[F.struct(F.substring_index(c, ":", 1).alias("path"), F.split(c, ":")[1].cast("long").alias("line"), F.substring_index(c, ":", -1).alias("symbol")) for c in ("left_id", "right_id")]).alias("evidence"))


@detector
def support_prelude_family(facts, modules, limits):
    """Three or more modules of one folder with one class and no function that import the same module."""
    top = family(facts, "class", "function").where("owner = '' and func = ''").groupBy("path").agg(F.count_if(F.col("family") == "class").alias("c"), F.count_if(F.col("family") == "function").alias("f")).where("c = 1 and f = 0")
    imports = family(facts, "import").where("owner = '' and func = ''").withColumn("support", F.regexp_replace("value", r"\.[^.]*$", "")).join(top, "path", "left_semi").dropDuplicates(["path", "support"])
    return grouped(imports, [F.regexp_replace("path", r"/?[^/]*$", ""), F.col("support")], 3)


@detector
def manual_family_roster(facts, modules, limits):
    """Lists of known classes that have an ancestor in common."""
    known = lineage.class_table(facts).select(F.col("name").alias("member"), "symbol").distinct()
    up = lineage.lineage(facts).select(F.col("descendant").alias("symbol"), "ancestor")
    r = family(facts, "roster").withColumn("id", F.concat_ws(":", "path", "line", "name")).withColumn("size", F.size(F.array_distinct("items")))
    members = r.select("id", "size", "path", "line", "name", F.explode(F.array_distinct("items")).alias("member"))
    shared = members.join(known, "member").join(up, "symbol").groupBy("id", "path", "line", "size", F.col("name"), "ancestor").agg(F.count_distinct("member").alias("have")).where("have = size and size >= 2")
    best = shared.groupBy("id", "path", "line", "name", "size").agg(F.min(F.struct(F.length("ancestor"), "ancestor")).alias("b"))
    return best.select(F.concat_ws(" < ", "name", "b.ancestor").alias("subject"), F.col("size").cast("long").alias("n"), F.array(F.struct("path", "line", F.col("name").alias("symbol"))).alias("evidence"))


@detector
def distributed_boundary_fanout(facts, modules, limits):
    """Field names declared by two or more classes and forwarded as keywords twice or more."""
    declared = owned(facts, "field").groupBy("name").agg(F.count_distinct("cls").alias("d")).where("d >= 2")
    uses = family(facts, "forwarded", "field").join(declared, "name")
    return grouped(uses, [F.col("name")], limits["min_boundary_fanout_sites"], F.count_if(F.col("family") == "forwarded").alias("f"), where="f >= 2")


@detector
def environment_authority_drift(facts, modules, limits):
    """Environment reads in functions other than those of a class named for the environment."""
    reads = family(facts, "env_read")
    authority = reads.where("owner rlike '(?i)environment'").select(F.col("path").alias("p"), F.col("owner").alias("o"), "name").distinct()
    outside = reads.join(authority, (reads["path"] == authority["p"]) & (reads["owner"] == authority["o"]), "left_anti")
    return single(outside.where("func <> ''").withColumn("name", F.concat(F.lit("$"), "name")))


@detector
def semantic_mirror(facts, modules, limits):
    """Names listed by hand that repeat the descendants of a class: two or more of them, and three or at least half."""
    closure = lineage.lineage(facts)
    simple = lambda c: F.substring_index(c, ".", -1)
    owned_facts = closure.select(F.col("ancestor").alias("authority"), names.normalized(simple("descendant")).alias("token"), F.col("descendant").alias("fact"))
    tails = owned_facts.unionByName(owned_facts.withColumn("token", F.expr("substring_index(token, '_', 1)")))
    listed = family(facts, "token").select(F.concat_ws(":", "path", "line", "name").alias("projection"), names.normalized(F.col("value")).alias("token")).distinct()
    rosters = family(facts, "roster").select(F.concat_ws(":", "path", "line", "name").alias("projection"), F.explode("items").alias("t")).select("projection", names.normalized(F.col("t")).alias("token"))
    totals = owned_facts.groupBy("authority").agg(F.count_distinct("fact").alias("total"))
    met = listed.union(rosters).distinct().join(tails, "token").groupBy("projection", "authority").agg(F.count_distinct("fact").alias("n"))
    edges = met.join(totals, "authority").where("n >= 2 and (n >= 3 or n / total >= 0.5)")
    return edges.select(F.concat_ws(" ~ ", "projection", "authority").alias("subject"), "n", F.array(F.struct(F.substring_index("projection", ":", 1).alias("path"), F.split("projection", ":")[1].cast("long").alias("line"), F.substring_index("projection", ":", -1).alias("symbol"))).alias("evidence"))


@detector
def repeated_field_family(facts, modules, limits):
    """Classes of one module that share two or more fields, at least half of each one's."""
    fields = owned(facts, "field").select("cls", "name").distinct()
    own = fields.groupBy("cls").agg(F.count("*").alias("k"))
    pairs = matching.overlap_pairs(fields, "cls", "name", 2)
    both = pairs.join(own.select(F.col("cls").alias("left_id"), F.col("k").alias("a")), "left_id").join(own.select(F.col("cls").alias("right_id"), F.col("k").alias("b")), "right_id").where("n_shared >= 0.5 * a and n_shared >= 0.5 * b and n_shared < a and n_shared < b")
    return at_classes(facts, both.select("left_id", "right_id", F.concat_ws(" & ", "left_id", "right_id").alias("subject"), F.col("n_shared").alias("n")), "left_id", "right_id")


@detector
def blank_line_run(facts, modules, limits):
    """More blank lines in a row than allowed."""
    runs = code.blank_runs(modules, limits["max_blank_lines"])
    return runs.select(F.concat_ws(":", "path", "line").alias("subject"), "n", F.array(F.struct("path", "line", F.lit("").alias("symbol"))).alias("evidence"))


def registries(facts):
    r = family(facts, "registration").withColumn("type", F.col("items")[0])
    return r.groupBy("path", "name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("keys"), F.count_distinct("type").alias("types"), F.slice(F.array_sort(F.collect_list(place())), 1, EVIDENCE).alias("evidence")).where("n >= 2")


@detector
def injective_type_registry(facts, modules, limits):
    """Registries with as many keys as types, one for each."""
    return registries(facts).where("keys = n and types = n").select(F.concat_ws(":", "path", "name").alias("subject"), "n", "evidence")


@detector
def non_injective_type_registry(facts, modules, limits):
    """Registries in which a key or a type stands twice."""
    return registries(facts).where("keys < n and types > 1 or types < n").select(F.concat_ws(":", "path", "name").alias("subject"), "n", "evidence")


@detector
def manual_registration(facts, modules, limits):
    return grouped(family(facts, "registration"), [F.col("name")], limits["min_registration_sites"])


@detector
def lifecycle_stage_sequence(facts, modules, limits):
    """The same calls in the same order in several functions, where one driver would be shorter."""
    rows = family(facts, "stages")
    out = grouped(rows, [F.col("value")], limits["min_stage_sites"])
    stages = F.size(F.split("subject", ">"))
    return out.where(certificate(F.col("n") * stages, F.lit(1), stages, F.col("n"), F.lit(1), F.lit(1))["pays_rent"])


@detector
def parallel_primitive_carrier(facts, modules, limits):
    """Pairs of classes that declare three or more fields of the same name and type."""
    roles = owned(facts, "field").select("cls", F.concat_ws(":", "name", "value").alias("role"))
    pairs = matching.overlap_pairs(roles, "cls", "role", 3)
    return at_classes(facts, pairs.select("left_id", "right_id", F.concat_ws(" & ", "left_id", "right_id").alias("subject"), F.col("n_shared").alias("n")), "left_id", "right_id")


@detector
def attribute_probes(facts, modules, limits):
    return grouped(family(facts, "probe"), [F.col("path")], limits["min_attribute_probes"])


@detector
def string_dispatch(facts, modules, limits):
    return single(family(facts, "dispatch").where((F.col("value") == "string") & (F.size("items") >= limits["min_string_cases"])))


@detector
def numeric_dispatch(facts, modules, limits):
    return single(family(facts, "dispatch").where((F.col("value") == "numeric") & (F.size("items") >= limits["min_string_cases"])))


@detector
def repeated_strategy_dispatch(facts, modules, limits):
    """The same set of cases branched on in two or more functions."""
    return grouped(family(facts, "dispatch").where(F.size("items") >= limits["min_string_cases"]), [F.col("value"), F.array_join("items", ",")], 2)


@detector
def repeated_builder_call(facts, modules, limits):
    return grouped(family(facts, "builder_call").where(F.size("items") >= limits["min_builder_keywords"]), [F.col("name"), F.col("value")], 2)


@detector
def repeated_export_dict(facts, modules, limits):
    return grouped(family(facts, "export_dict").where(F.size("items") >= limits["min_export_keys"]), [F.array_join("items", ",")], 2)


@detector
def literal_schema_owners(facts, modules, limits):
    """Literal mappings with the same fields in several owners."""
    rows = family(facts, "export_dict").where(F.size("items") >= limits["min_literal_schema_field_count"]).withColumn("by", F.concat_ws(".", "module", "owner", "func"))
    return grouped(rows, [F.array_join("items", ",")], limits["min_literal_schema_owner_count"], F.count_distinct("by").alias("owners"), where=f"owners >= {limits['min_literal_schema_owner_count']}")


@detector
def sentinel_type(facts, modules, limits):
    return single(family(facts, "sentinel"))


@detector
def runtime_type_generation(facts, modules, limits):
    return single(family(facts, "runtime_type"))


@detector
def dynamic_method_injection(facts, modules, limits):
    return single(family(facts, "injection"))


@detector
def type_lineage_map(facts, modules, limits):
    return single(family(facts, "lineage_map"))


@detector
def config_attribute_reads(facts, modules, limits):
    """One configuration attribute read in two or more functions."""
    return grouped(family(facts, "config_read").where("func <> ''"), [F.col("name")], 2, F.count_distinct(F.concat_ws(".", "path", "owner", "func")).alias("functions"), where="functions >= 2")


@detector
def repeated_regex_literal(facts, modules, limits):
    return grouped(family(facts, "regex").where(F.length("name") >= 4), [F.col("name")], limits["min_repeated_local_regex_literals"])


@detector
def repeated_string_literal(facts, modules, limits):
    """A string with a letter used in several places of two or more modules."""
    rows = family(facts, "string").where(F.col("name").rlike("[A-Za-z]{3}"))
    return grouped(rows, [F.col("name")], limits["min_hardcoded_string_sites"], F.count_distinct("path").alias("files"), where="files >= 2")


@detector
def mirrored_constant(facts, modules, limits):
    """The same name bound to the same literal in two or more modules."""
    return grouped(family(facts, "constant"), [F.col("name"), F.col("value")], 2, F.count_distinct("path").alias("files"), where="files >= 2")


@detector
def unreferenced_private_function(facts, modules, limits):
    """Long private functions and methods to whose name no module refers."""
    used = family(facts, "reference").select("name").distinct()
    private = family(facts, "function", "method").where((number("private") == 1) & (number("lines") >= limits["min_unreferenced_private_function_lines"]))
    return single(private.join(used, "name", "left_anti"))


@detector
def class_role_quotient(facts, modules, limits):
    """Classes whose methods fall, for at least half, into three or more roles by their first word."""
    m = owned(facts, "method").withColumn("role", F.regexp_extract("name", "^_*([a-z0-9]+)_", 1)).where("role <> ''")
    roles = m.groupBy("cls", "role").agg(F.count("*").alias("k"), F.collect_list(place()).alias("e")).where("k >= 2")
    total = owned(facts, "method").groupBy("cls").agg(F.count("*").alias("methods"), F.sum(number("private")).alias("private"))
    out = roles.groupBy("cls").agg(F.count("*").alias("roles"), F.sum("k").alias("n"), F.array_sort(F.flatten(F.collect_list("e"))).alias("evidence")).join(total, "cls").where("roles >= 3 and n * 2 >= methods and private * 2 > methods")
    return out.select(F.col("cls").alias("subject"), "n", F.slice("evidence", 1, EVIDENCE).alias("evidence"))


@detector
def empty_leaf_product(facts, modules, limits):
    """Four or more empty classes of two bases that fill a complete grid of left and right bases."""
    leaves = family(facts, "class").where((number("trivial") == 1) & (F.size("items") == 2)).select("path", "line", "owner", "func", "name", F.col("items")[0].alias("l"), F.col("items")[1].alias("r"))
    per_left = leaves.groupBy("l").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("rights"), F.count("*").alias("k"), F.collect_list(place()).alias("e"))
    out = per_left.where("k = size(split(rights, ','))").groupBy("rights").agg(F.count("*").alias("lefts"), F.sum("k").alias("n"), F.array_sort(F.flatten(F.collect_list("e"))).alias("evidence")).where("lefts >= 2 and n >= 4 and n = lefts * size(split(rights, ','))")
    return out.select(F.col("rights").alias("subject"), "n", F.slice("evidence", 1, EVIDENCE).alias("evidence"), F.array_distinct(F.transform("evidence", lambda e: e["path"])).alias("paths"))


@detector
def parallel_keyed_tables(facts, modules, limits):
    """Tables in different files that list nearly the same names."""
    r = family(facts, "roster").withColumn("id", F.concat_ws(":", "path", "line", "name"))
    atoms = r.select("id", F.explode("items").alias("t")).distinct()
    size = atoms.groupBy("id").agg(F.count("*").alias("k"))
    pairs = matching.overlap_pairs(atoms, "id", "t", 2).join(size.select(F.col("id").alias("left_id"), F.col("k").alias("a")), "left_id").join(size.select(F.col("id").alias("right_id"), F.col("k").alias("b")), "right_id")
    apart = pairs.where("substring_index(left_id, ':', 1) <> substring_index(right_id, ':', 1) and n_shared >= 0.8 * least(a, b)")
    return apart.select(F.concat_ws(" & ", "left_id", "right_id").alias("subject"), F.col("n_shared").alias("n"), F.array(*[F.struct(F.substring_index(c, ":", 1).alias("path"), F.split(c, ":")[1].cast("long").alias("line"), F.substring_index(c, ":", -1).alias("symbol")) for c in ("left_id", "right_id")]).alias("evidence"))


@detector
def branch_cluster(facts, modules, limits):
    """Functions of many branches."""
    big = (number("lines") >= limits["min_branch_cluster_function_lines"]) & (number("branches") >= limits["min_branch_cluster_branches"])
    return single(family(facts, "method", "function").where(big))


@detector
def protocol_contract(facts, modules, limits):
    return single(family(facts, "class").where(F.exists("items", lambda b: F.substring_index(b, ".", -1) == "Protocol")))


@detector
def locals_call(facts, modules, limits):
    return single(family(facts, "reflection").where("name = 'locals'"))


@detector
def reflective_builtin_calls(facts, modules, limits):
    """Functions that call reflective builtins twice or more."""
    return grouped(family(facts, "reflection").where("name <> 'locals'"), [F.col("path"), F.col("owner"), F.col("func")], limits["min_reflective_selector_values"])


@detector
def reflective_self_access(facts, modules, limits):
    return single(family(facts, "reflection").where("value = 'self'"))


@detector
def reflective_attribute_hook(facts, modules, limits):
    return single(family(facts, "method").where("name in ('__getattr__', '__getattribute__', '__setattr__', '__delattr__')"))


@detector
def constant_property_hook(facts, modules, limits):
    """Properties of one name that return a constant in several classes."""
    p = owned(facts, "method").where((number("property") == 1) & (number("constant") == 1))
    return grouped(p, [F.col("name")], 2, F.count_distinct("cls").alias("classes"), where="classes >= 2")


@detector
def property_alias(facts, modules, limits):
    """Properties that only return an attribute of self, two or more in a class."""
    p = owned(facts, "method").where((number("property") == 1) & (number("alias") == 1))
    return grouped(p, [F.col("cls")], 2)


@detector
def pass_through_wrapper(facts, modules, limits):
    return single(family(facts, "function", "method").where(number("passing") == 1))


@detector
def classvar_only_leaves(facts, modules, limits):
    """Classes of one base with nothing but assignments."""
    c = family(facts, "class").where((number("assignments") > 0) & (number("assignments") == number("members")) & (F.size("items") == 1))
    return grouped(c, [F.col("items")[0]], limits["min_family_size"])


@detector
def repeated_base_bundle(facts, modules, limits):
    """The same two bases or more in several classes."""
    return grouped(family(facts, "class").where(F.size("items") >= 2), [F.array_join("items", ",")], 2)


@detector
def manual_public_api(facts, modules, limits):
    return single(family(facts, "public_api"))


@detector
def optional_parameter_branch(facts, modules, limits):
    return single(family(facts, "optional_branch"))


@detector
def repeated_structural_annotation(facts, modules, limits):
    return grouped(family(facts, "annotation").where(F.length("name") >= 12), [F.col("name")], limits["min_family_size"])


@detector
def duplicate_visitor_method(facts, modules, limits):
    """visit_ methods of one class with like bodies."""
    v = owned(facts, "method").where("name like 'visit~_%' escape '~'")
    return grouped(v, [F.col("cls"), F.col("value")], 2)


@detector
def alternate_constructors(facts, modules, limits):
    """Class methods named from_..., three or more in a class."""
    v = owned(facts, "method").where((number("classmethod") == 1) & F.col("name").startswith("from_"))
    return grouped(v, [F.col("cls")], limits["min_family_size"])


@detector
def identity_keyword_forwarding(facts, modules, limits):
    return single(family(facts, "identity_forward"))


@detector
def repeated_type_cases(facts, modules, limits):
    """The same set of two types or more asked for in several functions."""
    asked = family(facts, "isinstance").select("path", "owner", "func", "name", F.explode("items").alias("t"), "line", "end_line", "value", "items", "numbers", "module", "family")
    sets = asked.groupBy("path", "owner", "func", "name").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types"), F.min("line").alias("line"))
    return grouped(sets.where("types like '%,%'"), [F.col("types")], 2)


@detector
def suffix_axis_surface(facts, modules, limits):
    """Two or more operations of a class that stand for the same two suffixes or more (load_json, load_yaml, ...)."""
    m = owned(facts, "method").withColumn("op", F.regexp_extract("name", "^([a-z0-9_]+)_([a-z0-9]+)$", 1)).withColumn("axis", F.regexp_extract("name", "^([a-z0-9_]+)_([a-z0-9]+)$", 2)).where("op <> ''")
    ops = m.groupBy("cls", "op").agg(F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("axes"), F.array_sort(F.collect_list(place())).alias("e")).where("axes like '%,%'")
    out = ops.groupBy("cls", "axes").agg(F.count("*").alias("n"), F.array_sort(F.flatten(F.collect_list("e"))).alias("evidence")).where("n >= 2")
    return out.select(F.concat_ws(" | ", "cls", "axes").alias("subject"), "n", F.slice("evidence", 1, EVIDENCE).alias("evidence"))


@detector
def prefixed_field_bundle(facts, modules, limits):
    """Two prefixes of a class's fields with the same rests (left_x, right_x, ...), enough of them."""
    f = owned(facts, "field").select("cls", F.regexp_extract("name", "^([a-z0-9]+)_(.+)$", 1).alias("p"), F.regexp_extract("name", "^([a-z0-9]+)_(.+)$", 2).alias("rest")).where("p <> ''").distinct()
    pairs = f.withColumn("id", F.concat_ws("/", "cls", "p")).withColumn("atom", F.concat_ws("/", "cls", "rest"))
    both = matching.overlap_pairs(pairs, "id", "atom", limits["min_role_bundle_fields"])
    return at_classes(facts, both.select("left_id", "right_id", F.concat_ws(" & ", "left_id", "right_id").alias("subject"), F.col("n_shared").alias("n")), "left_id", "right_id")


@detector
def private_helper_shadow(facts, modules, limits):
    """Private functions with the body of a public function elsewhere."""
    f = family(facts, "function").where(number("statements") >= limits["min_duplicate_statements"])
    public = f.where(number("private") == 0).select("value", F.size("items").alias("k"), F.col("path").alias("other")).distinct()
    private = f.where(number("private") == 1).withColumn("k", F.size("items"))
    return single(private.join(public, ["value", "k"]).where("path <> other").dropDuplicates(["path", "line", "name"]))


@detector
def empty_authority_shell(facts, modules, limits):
    """Empty classes without descendants to whose name no other module refers."""
    up = lineage.resolved_bases(facts).where("resolved is not null").select(F.col("resolved").alias("symbol")).distinct()
    shells = lineage.class_table(facts).where(number("trivial") == 1).join(up, "symbol", "left_anti")
    used = family(facts, "reference").select("name", F.col("path").alias("other")).distinct()
    free = shells.select("name", "path", "line", F.lit("").alias("owner"), F.lit("").alias("func")).join(used, "name", "left").groupBy("path", "line", "name", "owner", "func").agg(F.count_if(F.col("other") != F.col("path")).alias("k")).where("k = 0")
    return single(free)


@detector
def packed_line(facts, modules, limits):
    lines = code.packed_lines(modules)
    return lines.select(F.concat_ws(":", "path", "line").alias("subject"), F.lit(1).cast("long").alias("n"), F.array(F.struct("path", "line", F.substring(F.trim("text"), 1, 60).alias("symbol"))).alias("evidence"))


@detector
def syntax_errors(facts, modules, limits):
    return single(family(facts, "syntax_error"))


def of_detector(name: str, found: DataFrame) -> DataFrame:
    paths = F.col("paths") if "paths" in found.columns else F.array_distinct(F.transform("evidence", lambda e: e["path"]))
    return found.select(F.lit(name).alias("detector"), "subject", F.col("n").cast("long").alias("n"), "evidence", paths.alias("paths"))


def findings(facts: DataFrame, modules: DataFrame, only: list[str] | None = None, excluded: tuple[str, ...] = (), limits: dict | None = None) -> DataFrame:
    """All findings of the chosen detectors, with an id that depends on what is found."""
    settings = LIMITS | (limits or {})
    parts = [of_detector(n, DETECTORS[n](facts, modules, settings)) for n in only or DETECTORS if n not in excluded]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("finding_id", names.stable_id(F.col("detector"), F.col("subject"), F.to_json("evidence")))


def in_scope(found: DataFrame, roots: list[str]) -> DataFrame:
    """Findings with a place in one of the roots: folders, or modules with or without their ending; whole parts of a path count."""
    trimmed = [r.rstrip("/") for r in roots]
    under = lambda p: grouping.any_of([p.isin(r, f"{r}.py") | p.startswith(f"{r}/") for r in trimmed])
    return found.where(F.exists("paths", under))


def analyze(spark: SparkSession, roots: list[str], only: list[str] | None = None) -> DataFrame:
    """Scan, parse once, and run the detectors on the settled facts."""
    source = settle(code.modules(spark, roots), "modules")
    return findings(settle(code.facts(source), "facts"), source, only)


from fiberloom.plans import surfaces  # noqa: E402, F401
