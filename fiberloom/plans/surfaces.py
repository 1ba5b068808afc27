"""More detectors, most of them declared by the family of facts they look at and what makes a group of it.

``flag`` reports every fact that fits; ``bundle`` reports groups of facts with the same keys.  The rules of the others are
written out.  Numbers are those of the survey's inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.functions import names
from fiberloom.operators import classes as lineage
from fiberloom.operators import matching, search
from fiberloom.plans.detectors import DETECTORS, at_classes, detector, grouped, owned, single
from fiberloom.sources.code import family

#: Number in the survey's inventory, by detector.
NUMBERS: dict[str, str] = {
    "parallel_primitive_carrier": "D003", "environment_authority_drift": "D004", "semantic_mirror": "D008", "repeated_field_family": "D010", "prefixed_field_bundle": "D011", "property_alias": "D012",
    "constant_property_hook": "D013", "reflective_self_access": "D014", "classvar_only_leaves": "D016", "runtime_type_generation": "D017", "alternate_constructors": "D024", "support_prelude_family": "D025",
    "manual_family_roster": "D026", "pass_through_wrapper": "D032", "distributed_boundary_fanout": "D037", "protocol_contract": "D038", "repeated_method_shape": "D039", "hierarchy_candidate": "D040",
    "orchestration_hub": "D041", "branch_cluster": "D042", "class_role_quotient": "D043", "parameter_thread_family": "D045", "suffix_axis_surface": "D046", "repeated_strategy_dispatch": "D049",
    "empty_leaf_product": "D052", "repeated_type_cases": "D069", "manual_registration": "D084", "reflective_builtin_calls": "D088", "locals_call": "D089", "reflective_attribute_hook": "D090",
    "repeated_base_bundle": "D099", "manual_public_api": "D100", "blank_line_run": "D105", "packed_line": "D106", "empty_authority_shell": "D119", "parallel_keyed_tables": "D129",
    "non_injective_type_registry": "D130", "injective_type_registry": "D131", "identity_keyword_forwarding": "D143", "optional_parameter_branch": "D149", "repeated_structural_annotation": "D160",
    "private_helper_shadow": "D163", "lifecycle_stage_sequence": "D168", "duplicate_visitor_method": "D170",
}
BY = "concat_ws('.', nullif(owner, ''), nullif(func, ''), name)"
CLASS = "concat_ws('.', module, nullif(owner, ''))"
ITEMS = "array_join(items, ',')"


def numbered(number: str):
    def put(f):
        NUMBERS[f.__name__] = number
        return detector(f)

    return put


def declared(number: str, name: str, rule: str, body) -> None:
    body.__name__, body.__doc__ = name, rule
    NUMBERS[name] = number
    DETECTORS[name] = body


def flag(number: str, name: str, kind: str, rule: str, where: str = "true") -> None:
    declared(number, name, rule, lambda facts, modules, limits: single(family(facts, kind).where(where)))


def bundle(number: str, name: str, kind: str, keys: tuple[str, ...], rule: str, least: int | str = 2, where: str = "true", having: str = "true", **more: str) -> None:
    def body(facts, modules, limits):
        at_least = limits[least] if isinstance(least, str) else least
        return grouped(family(facts, kind).where(where), [F.expr(k) for k in keys], at_least, *[F.expr(e).alias(n) for n, e in more.items()], where=having)

    declared(number, name, rule, body)


DISTINCT_CLASSES = {"classes": f"count(distinct {CLASS})"}

bundle("D009", "renamed_slices", "record_class", ("path", "array_join(transform(items, x -> regexp_extract(x, ':(.*)=', 1)), ',')"), "Records of one module with the same types in the same order under other names.", where="size(items) >= 3", having="shapes >= 2", shapes="count(distinct array_join(transform(items, x -> substring_index(x, ':', 1)), ','))")
bundle("D015", "helper_backed_classes", "helper_class", ("path", "value"), "Classes of one base whose only method calls a helper.", where="value <> ''")
bundle("D019", "type_indexed_definitions", "assigned", ("path", "value", "array_join(transform(items, x -> substring_index(x, '=', 1)), ',')"), "Classes of like bases that assign the same names and nothing else, two or more of them.", where="numbers['only'] = 1 and numbers['count'] >= 2 and value <> ''")
bundle("D021", "export_policy_predicate", "policy_predicate", (ITEMS,), "Functions that return the same conjunction of tests.")
bundle("D023", "subclass_traversal", "subclass_walk", ("value", ITEMS), "Functions that walk subclasses of the same roots by hand in the same way.")
flag("D028", "runtime_adapter_shell", "adapter_shell", "A record rebuilt from another by copying fields and looking others up in a table.")
bundle("D033", "finding_assembly", "assembly_loop", ("path", "value"), "The same loop from a collector to what is built, in several classes.", where="owner <> ''", having="classes >= 2", **DISTINCT_CLASSES)
bundle("D034", "projection_builder", "projection_call", ("path", "name", ITEMS), "A record built from one source field by field at several places of a module.")
bundle("D035", "guarded_delegator", "guarded_delegate", ("path", "value"), "A guard before the same call, in several classes.", where="owner <> ''", having="classes >= 2", **DISTINCT_CLASSES)
bundle("D036", "projection_properties", "projection_property", ("path", "name", "value", ITEMS), "A property of several classes that builds the same record.", where="owner <> ''", having="classes >= 2", **DISTINCT_CLASSES)
flag("D048", "residual_closed_axis", "residual_axis", "A table indexed by what the function also compares with a case.")
flag("D050", "enum_subset_guard", "enum_subset", "Membership in a subset of an enum's cases, spelled out.")
flag("D053", "closed_constant_selector", "constant_selector", "A function that branches to one of several constants.")
flag("D058", "callable_axis_registry", "enum_table", "A table from cases to callables.", "numbers['callable'] = 1")
flag("D062", "enum_constructor_table", "enum_table", "A table from cases to constructor calls.", "numbers['constructor'] = 1")
bundle("D065", "parallel_registry_projection", "registry_projection", ("path", "value"), "Functions that pass different roots' accessors to one collector.", having="roots >= 2", roots="count(distinct items[0])")
bundle("D066", "repeated_keyed_family", "registry_class", (ITEMS,), "Classes with a registry and the same lookups.", "min_registration_sites")
bundle("D067", "manual_keyed_records", "registry_class", ("path", ITEMS), "Classes of one module with a registry, a register method and the same lookups.", "min_registration_sites", where="value = 'register'")
bundle("D068", "record_mechanics_by_hand", "record_mechanics", ("path", ITEMS), "Dataclasses of one module that write the same fieldwise methods.", "min_registration_sites")
bundle("D071", "guard_validators", "attribute_guards", ("path", ITEMS), "Validators with the same attribute checks.")
flag("D072", "all_missing_axes", "all_missing", "A conjunction of absences before something is appended.")
bundle("D074", "result_assembly", "stage_tail", ("path", "value"), "Functions with the same last three stages and other first ones.", having="heads >= 2", heads="count(distinct items[0])")
flag("D075", "fail_soft_pipeline", "fail_soft", "Two or more guards that leave with nothing.", "numbers['guards'] >= 2")
flag("D080", "direct_finding_renderer", "finding_builder", "A method that only builds a finding.", "value = 'direct'")
flag("D153", "finding_spec_build", "finding_builder", "A build call that is given the detector's own id.", "value = 'spec'")
flag("D082", "derived_counts", "counted_keywords", "A count given beside the collection it counts.")
flag("D102", "concrete_type_union", "type_union", "A parameter that takes one of several classes themselves.")
bundle("D103", "constructor_variants", "constructor_return", (CLASS, "value"), "Methods of a class that return the same constructor.", where="owner <> ''")
bundle("D109", "sparse_constructor_variants", "constructor_return", (CLASS,), "Class methods that set one field each.", where="numbers['classmethod'] = 1 and size(items) = 1 and owner <> ''", having="fields >= 2", fields="count(distinct items[0])")
bundle("D104", "accumulator_folds", "fold", (CLASS, "value"), "Methods of a class that fold with the same accumulator.", where="owner <> ''")
bundle("D107", "catalog_mixins", "catalog_hook", ("path", ITEMS), "Classes whose subclass hook installs the same catalogs.")
bundle("D108", "regex_group_extractors", "regex_group", (CLASS, "value"), "Methods of a class that return the same group of a match.", where="owner <> ''")
bundle("D110", "constructor_policy_rows", "spec_row", ("path", "value", "array_join(transform(items, x -> substring_index(x, '=', 1)), ',')"), "Module constants built by one constructor from the same keywords.", 3)
flag("D111", "dynamic_self_fields", "dynamic_self", "Reflection on self with a computed name.")
flag("D112", "string_backed_lookup", "string_lookup", "Names found through a string that self holds.")
bundle("D113", "linear_queries", "linear_query", ("path", "value"), "Functions that look through one collection for a key.")
flag("D115", "keyword_bag_adapter", "kwargs_adapter", "A dictionary of one parameter's fields.")
bundle("D121", "stream_materialisation", "stream", (CLASS, "value"), "Methods of a class that materialise one collection.", where="owner <> '' and numbers['property'] = 0")
bundle("D124", "collection_projections", "stream", (CLASS, "value"), "Properties of a class that project members of one collection.", where="owner <> '' and numbers['property'] = 1 and numbers['projects'] = 1")
flag("D122", "inline_tree_predicates", "tree_matcher", "Methods with three or more tests of node kinds inside a loop.", "numbers['kinds'] >= 3 and numbers['looped'] = 1 and owner <> ''")
flag("D076", "tree_matcher_payoff", "tree_matcher", "Functions whose exits, node tests and length checks score eight or more.", "numbers['score'] >= 8")
bundle("D123", "path_properties", "path_property", (CLASS,), "Properties of a class that derive paths.", where="owner <> ''")
bundle("D125", "template_payloads", "template_payload", (CLASS,), "Methods of a class that return templates of several lines.", where="owner <> ''")
flag("D126", "enum_strategy_ladder", "enum_branch", "A function that branches on two or more cases.", "size(items) >= 2")
flag("D135", "step_owns_apply", "fail_soft", "Steps whose apply method guards by itself.", "name = 'apply' and owner like '%Step%'")
flag("D137", "collector_boilerplate", "passes_to_collector", "A method that only passes on to a collector.", "owner <> ''")
flag("D138", "typed_cast_first", "typed_cast", "A method whose first statement casts its parameter.")
flag("D139", "metadata_only_detector", "assigned", "A detector class of nothing but assignments.", "name like '%Detector' and numbers['only'] = 1 and value like '%Detector%' and value not like '%Observation%'")
flag("D140", "static_observation_detector", "assigned", "An observation detector that repeats a static shell.", "value like '%ObservationDetector%' and exists(items, x -> x like 'observation%')")
flag("D141", "inline_renderers", "call_constants", "A declaration with two or more renderers in it.", "value = 'renderers'")
flag("D142", "named_function_collector", "stream_collector", "A collector over named functions.", "value like '%named_functions%'")
flag("D152", "stream_collector_boilerplate", "stream_collector", "A collector over a stream.", "value not like '%named_functions%'")
flag("D144", "optional_keyword_bag", "optional_bag", "A call variant put together from optional parameters.")
bundle("D145", "schema_accessors", "schema_accessor", (CLASS, "value"), "Methods of a class that read cases of one enum.", where="owner <> ''")
bundle("D147", "field_projections", "field_projection", (CLASS, "value"), "Methods of a class that put their own fields through one helper.", where="owner <> ''")
flag("D148", "tuple_paths_in_calls", "tuple_paths", "Nested positions given to calls.")
bundle("D150", "bare_function_family", "owner_reads", ("path", "value", ITEMS), "Functions that read the same attributes of a first parameter of one type.", 3, where="owner = '' and numbers['typed'] = 1")
bundle("D151", "latent_function_family", "owner_reads", ("path", "value", ITEMS), "Functions that read the same attributes of a first parameter without a type.", 3, where="owner = '' and numbers['typed'] = 0")
flag("D156", "spelled_spec_coordinates", "call_constants", "A specification built from three coordinates or more.", "value = 'coordinates'")
flag("D157", "runtime_product_record", "call_constants", "A record made at run time.", "value = 'product'")
bundle("D081", "tag_tuples", "call_constants", ("path", "name", ITEMS), "The same tuple of tags given by keyword.", where="value = 'tags'")
flag("D118", "alias_catalog", "alias_class", "A class of nothing but aliases.", "value = 'catalog'")
flag("D158", "property_alias_class", "alias_class", "A class of nothing but property aliases.", "value = 'properties' and size(items) >= 2")
flag("D159", "property_alias_method", "method", "A property that only returns an attribute.", "numbers['property'] = 1 and numbers['alias'] = 1")
flag("D161", "location_property", "location_property", "A property that builds a location of three attributes.", "value = 'direct'")
flag("D162", "zipped_location_property", "location_property", "A property that builds locations of zipped attributes.", "value = 'zipped'")
bundle("D166", "bridge_axis_dispatch", "dispatch", ("path", "name", ITEMS), "Functions that branch on one expression over the same literals.", having="functions >= 2", functions="count(distinct concat_ws('.', owner, func))")
bundle("D167", "capability_probes", "probes", ("path", ITEMS), "Functions that probe for the same attributes.")
flag("D169", "visitor_stack", "visitor_stacks", "A visitor that keeps its stacks by hand.")
flag("D171", "enum_metadata_table", "enum_table_property", "An enum's property that reads a table by the member.")
flag("D173", "manual_fiber_tag", "fiber_tag", "A tag that methods branch on beside other fields.")
flag("D174", "stale_derived_views", "derived_views", "Views that a mutator of their source does not renew.")
bundle("D087", "uppercase_globals", "mutable_global", ("path",), "Mutable globals in capitals.", 1)
bundle("D098", "self_naming_builders", "self_naming", ("path", "value"), "Assignments in a class that repeat their own names.", 3)
bundle("D096", "constant_property_bundle", "method", (CLASS,), "A class with several constant properties.", where="numbers['property'] = 1 and numbers['constant'] = 1 and owner <> ''")
bundle("D097", "metadata_only_family", "assigned", ("path", "regexp_extract(name, '([A-Z][a-z0-9]*)$', 1)"), "Classes without a base, of one last word, that only assign.", where="numbers['only'] = 1 and value = ''")
bundle("D120", "module_alias_catalog", "alias", ("path", "substring_index(value, '.', 1)"), "Module names that alias members of one authority.", where="numbers['member'] = 1 and value rlike '^[A-Z]'")
flag("D101", "registered_union", "registry_call", "Several roots' accessors joined by hand.")
bundle("D164", "option_records", "record_class", ("path", "array_join(transform(items, x -> substring_index(x, ':', 1)), ',')"), "Records of one module with the same defaulted fields.", where="size(items) >= 2 and numbers['defaults'] = size(items)")


@numbered("D083")
def nested_builder_shell(facts, modules, limits):
    """A record around another one that is given four or more parameters as they came."""
    return single(family(facts, "nested_builder").where("size(items) >= 4"))


@numbered("D018")
def auto_register_misuse(facts, modules, limits):
    """Registering classes without methods that nothing descends from."""
    up = family(facts, "class").select(F.explode("items").alias("name")).distinct()
    return single(family(facts, "meta").where("value like '%AutoRegister%' and numbers['methods'] = 0").join(up, "name", "left_anti"))


def local_roots(facts: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` (path, line, owner, func, name, items) where all items are classes of the module with a base in common."""
    known = family(facts, "class").select("path", F.col("name").alias("_m"), F.explode("items").alias("_base")).distinct()
    each = listed.select("path", "line", "name", F.size(F.array_distinct("items")).alias("_all"), F.explode(F.array_distinct("items")).alias("_m")).join(known, ["path", "_m"])
    met = each.groupBy("path", "line", "name", "_all", "_base").agg(F.count_distinct("_m").alias("_have")).where("_have = _all and _all >= 2")
    return met.groupBy("path", "line", "name", "_all").agg(F.min("_base").alias("root"))


def listing(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws(" < ", "name", "root").alias("subject"), F.col("_all").cast("long").alias("n"), F.array(F.struct("path", "line", F.col("name").alias("symbol"))).alias("evidence"))


@numbered("D020")
def derived_exports(facts, modules, limits):
    """Lists of names that are exactly classes of one base in the module."""
    return listing(local_roots(facts, family(facts, "string_list")))


@numbered("D022")
def derived_index(facts, modules, limits):
    """Tables whose values are exactly classes of one base in the module."""
    return listing(local_roots(facts, family(facts, "roster").where("value = 'mapping'")))


def spots(pairs: DataFrame) -> Column:
    """Evidence of two ids ``path:line:name``."""
    return F.array(*[F.struct(F.substring_index(c, ":", 1).alias("path"), F.split(c, ":")[1].cast("long").alias("line"), F.substring_index(c, ":", -1).alias("symbol")) for c in ("left_id", "right_id")])


def named(facts: DataFrame, kind: str) -> DataFrame:
    return family(facts, kind).withColumn("id", F.concat_ws(":", "path", "line", "name"))


def pair_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat_ws(" & ", F.substring_index("left_id", ":", -1), F.substring_index("right_id", ":", -1)).alias("subject"), F.col("n_shared").alias("n"), spots(pairs).alias("evidence"))


def path_of(c: str) -> Column:
    return F.substring_index(c, ":", 1)


@numbered("D027")
def fragmented_tables(facts, modules, limits):
    """Tables of one module that share two cases or more of an enum."""
    t = named(facts, "enum_table").select("id", F.explode("items").alias("case"), "value")
    pairs = matching.overlap_pairs(t.withColumn("atom", F.concat_ws(".", "value", "case")), "id", "atom", 2)
    return pair_rows(pairs.where(path_of("left_id") == path_of("right_id")))


@numbered("D054")
def derived_wrapper_specs(facts, modules, limits):
    """Two or more constants of a module whose constructor links to other constants of it."""
    return grouped(family(facts, "spec_row").where("numbers['links'] >= 1"), [F.col("path"), F.col("value")], 2)


@numbered("D064")
def cross_module_specs(facts, modules, limits):
    """Families of rows in different modules that share two rows or more."""
    rows = family(facts, "spec_row").select(F.concat_ws(":", "path", F.lit("1"), "value").alias("id"), F.array_join("items", ",").alias("row")).where("row like '%,%'")
    return pair_rows(matching.overlap_pairs(rows, "id", "row", 2).where(path_of("left_id") != path_of("right_id")))


def keyed_families(facts: DataFrame) -> DataFrame:
    """(id, path, enum, case): classes of one base in a module that each declare a case."""
    k = family(facts, "keyed_class").where("numbers['keyed_by'] = 1 and value <> ''")
    case = F.col("items")[0]
    rows = k.select("path", "line", F.col("value").alias("base"), F.substring_index(case, ".", 1).alias("enum"), F.substring_index(case, ".", -1).alias("case"))
    first = rows.groupBy("path", "base", "enum").agg(F.min("line").alias("line"), F.collect_set("case").alias("cases")).where("size(cases) >= 2")
    return first.select(F.concat_ws(":", "path", "line", "base").alias("id"), "path", "enum", "cases")


@numbered("D055")
def closed_axis_branching(facts, modules, limits):
    """Functions that branch over cases which a family of classes already declares, two of them or more."""
    own = keyed_families(facts).select("enum", F.explode("cases").alias("case"), F.col("id").alias("family"))
    asked = family(facts, "enum_branch").select("path", "line", "owner", "func", "name", F.col("value").alias("enum"), F.explode("items").alias("case"))
    met = asked.join(own, ["enum", "case"]).groupBy("path", "line", "owner", "func", "name", "family").agg(F.count_distinct("case").alias("k")).where("k >= 2")
    return single(met.dropDuplicates(["path", "line", "name"]))


def family_pairs(facts: DataFrame) -> DataFrame:
    rows = keyed_families(facts).select("id", F.explode("cases").alias("case"), "enum")
    return matching.overlap_pairs(rows.withColumn("atom", F.concat_ws(".", "enum", "case")), "id", "atom", 2)


@numbered("D056")
def parallel_keyed_families(facts, modules, limits):
    """Two families of one module over the same cases."""
    return pair_rows(family_pairs(facts).where(path_of("left_id") == path_of("right_id")))


@numbered("D128")
def cross_module_families(facts, modules, limits):
    """Two families of different modules over the same cases."""
    return pair_rows(family_pairs(facts).where(path_of("left_id") != path_of("right_id")))


def table_family_pairs(facts: DataFrame, kind: str) -> DataFrame:
    t = named(facts, "enum_table").where(kind).select(F.col("id").alias("left_id"), F.col("value").alias("enum"), F.explode("items").alias("case"))
    own = keyed_families(facts).select(F.col("id").alias("right_id"), "enum", F.explode("cases").alias("case"))
    return t.join(own, ["enum", "case"]).groupBy("left_id", "right_id").agg(F.count_distinct("case").alias("n_shared")).where("n_shared >= 2")


@numbered("D057")
def keyed_table_and_family(facts, modules, limits):
    """A table and a family of classes in different modules over the same cases."""
    return pair_rows(table_family_pairs(facts, "true").where(path_of("left_id") != path_of("right_id")))


@numbered("D061")
def table_shadows_classes(facts, modules, limits):
    """A table of types beside the classes of its module that declare the same cases."""
    return pair_rows(table_family_pairs(facts, "numbers['type'] = 1").where(path_of("left_id") == path_of("right_id")))


@numbered("D001")
def abstraction_reuse(facts, modules, limits):
    """Functions that do again what an imported function of another module does.

    Five atoms shared, 0.40 of the authority's and 0.35 of the function's own; the best authority of each counts.
    """
    f = named(facts, "capability").where("owner = ''")
    atoms = f.select("id", F.explode("items").alias("atom"))
    size = f.select("id", F.size("items").alias("k"), "path", "name")
    pairs = matching.overlap_pairs(atoms, "id", "atom", 5)
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "n_shared"))
    both = both.join(size.select(F.col("id").alias("left_id"), F.col("k").alias("own"), F.col("path").alias("here")), "left_id").join(size.select(F.col("id").alias("right_id"), F.col("k").alias("theirs"), F.col("name").alias("authority"), F.col("path").alias("there")), "right_id")
    imported = family(facts, "import").select(F.col("path").alias("here"), F.substring_index("value", ".", -1).alias("authority")).distinct()
    calls = family(facts, "callees").select(F.concat_ws(":", "path", "line", "name").alias("left_id"), F.explode("items").alias("authority")).distinct()
    fit = both.where("here <> there and n_shared >= 0.4 * theirs and n_shared >= 0.35 * own").join(imported, ["here", "authority"], "left_semi").join(calls, ["left_id", "authority"], "left_anti")
    best = fit.groupBy("left_id").agg(F.max(F.struct("n_shared", F.col("right_id"))).alias("b")).select("left_id", "b.n_shared", "b.right_id")
    return pair_rows(best)


def field_sets(facts: DataFrame) -> DataFrame:
    return owned(facts, "field").select("cls", "name", "path", "owner").distinct()


def unrelated(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of classes of which neither descends from the other and that have no ancestor in common."""
    up = lineage.lineage(facts).select("descendant", "ancestor")
    own = up.unionByName(lineage.class_table(facts).select(F.col("symbol").alias("descendant"), F.col("symbol").alias("ancestor"))).distinct()
    common = pairs.select("left_id", "right_id").join(own.withColumnRenamed("descendant", "left_id"), "left_id").join(own.withColumnRenamed("descendant", "right_id"), ["right_id", "ancestor"]).select("left_id", "right_id").distinct()
    return pairs.join(common, ["left_id", "right_id"], "left_anti")


def carrier_pairs(facts: DataFrame, least: int) -> DataFrame:
    """Unrelated classes of different files that share fields, with the number of each one's."""
    fields = field_sets(facts)
    own = fields.groupBy("cls").agg(F.count("*").alias("k"), F.min("path").alias("path"))
    pairs = unrelated(facts, matching.overlap_pairs(fields, "cls", "name", least))
    pairs = pairs.join(own.select(F.col("cls").alias("left_id"), F.col("k").alias("a"), F.col("path").alias("p")), "left_id").join(own.select(F.col("cls").alias("right_id"), F.col("k").alias("b"), F.col("path").alias("q")), "right_id")
    return pairs.where("p <> q")


def class_pairs(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    return at_classes(facts, pairs.select("left_id", "right_id", F.concat_ws(" & ", "left_id", "right_id").alias("subject"), F.col("n_shared").alias("n")), "left_id", "right_id")


@numbered("D002")
def carrier_reuse(facts, modules, limits):
    """Records that repeat three fields or more, and all of their own, of a record in another file."""
    records = family(facts, "record_class").select(F.concat_ws(".", "module", "name").alias("c"))
    some = carrier_pairs(facts, 3).where("n_shared = a or n_shared = b")
    return class_pairs(facts, some.join(records.withColumnRenamed("c", "left_id"), "left_id", "left_semi").join(records.withColumnRenamed("c", "right_id"), "right_id", "left_semi"))


def authorities(facts: DataFrame) -> DataFrame:
    """Classes that are abstract: with an abstract method or ABC among their bases."""
    return family(facts, "class").where("numbers['abstract'] = 1 or exists(items, b -> b like '%ABC')").select(F.concat_ws(".", "module", "name").alias("authority"))


def against_authority(facts: DataFrame, least: int) -> DataFrame:
    """(left_id: the class, right_id: the abstract one, n_shared) of unrelated classes in different files."""
    pairs = carrier_pairs(facts, least).select("left_id", "right_id", "n_shared")
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "n_shared"))
    a = authorities(facts)
    return both.join(a.withColumnRenamed("authority", "right_id"), "right_id", "left_semi").join(a.withColumnRenamed("authority", "left_id"), "left_id", "left_anti")


NAMED_AFTER = "locate(substring_index(right_id, '.', -1), substring_index(left_id, '.', -1)) > 0"


@numbered("D029")
def authority_reuse(facts, modules, limits):
    """Classes that repeat three fields or more of an abstract class elsewhere."""
    return class_pairs(facts, against_authority(facts, 3).where(f"not {NAMED_AFTER}"))


@numbered("D030")
def authority_retreat(facts, modules, limits):
    """Classes named after an abstract class elsewhere that repeat its fields and stay outside."""
    return class_pairs(facts, against_authority(facts, 2).where(NAMED_AFTER))


@numbered("D031")
def duplicate_surface(facts, modules, limits):
    """Unrelated classes that share two fields and two methods or more."""
    fields = matching.overlap_pairs(field_sets(facts), "cls", "name", 2)
    m = owned(facts, "method").where("not name like '~_~_%' escape '~'")
    calls = matching.overlap_pairs(m, "cls", "name", 2).select("left_id", "right_id", F.col("n_shared").alias("k"))
    both = unrelated(facts, fields.join(calls, ["left_id", "right_id"])).withColumn("n_shared", F.col("n_shared") + F.col("k"))
    return class_pairs(facts, both)


@numbered("D044")
def private_cohort(facts, modules, limits):
    """Four or more private functions of a long module that share two words of their names."""
    size = modules.select("path", F.size(F.split("source", "\n")).alias("lines")).where(F.col("lines") >= max(240, 4 * limits["min_orchestration_function_lines"]))
    own = family(facts, "function", "class").where("owner = '' and func = '' and name like '~_%' escape '~'").join(size.select("path"), "path", "left_semi")
    words = own.withColumn("w", names.tokens(F.col("name")))
    first = words.withColumn("a", F.explode("w")).withColumn("b", F.explode("w")).where("a < b")
    return grouped(first, [F.col("path"), F.concat_ws("_", "a", "b")], max(4, limits["min_registration_sites"] + 2))


@numbered("D047")
def sibling_role_helpers(facts, modules, limits):
    """Functions of one owner whose names differ in one word and that call the same two things or more."""
    f = family(facts, "callees").where("size(items) >= 2").withColumn("w", F.split("name", "_"))
    keyed = f.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("w") - 1))).where("size(w) >= 2").withColumn("_key", F.array_join(F.transform("w", lambda x, i: F.when(i == F.col("_i"), F.lit("*")).otherwise(x)), "_"))
    return grouped(keyed, [F.col("path"), F.col("owner"), F.col("_key"), F.array_join("items", ",")], 2)


@numbered("D051")
def split_dispatch(facts, modules, limits):
    """Functions that select a strategy and call a generic function of their module as well."""
    generic = family(facts, "generic_function").select("path", F.col("name").alias("callee")).distinct()
    both = family(facts, "strategy_selector").withColumn("callee", F.explode("items")).join(generic, ["path", "callee"])
    return single(both.dropDuplicates(["path", "line", "name"]))


def assignments(facts: DataFrame) -> DataFrame:
    """(symbol, path, line, attr, said): what classes assign."""
    a = family(facts, "class_assignment")
    return a.select(F.concat_ws(".", "module", "owner").alias("symbol"), "path", "line", "owner", F.col("name").alias("attr"), F.col("value").alias("said"))


@numbered("D059")
def repeated_registry_config(facts, modules, limits):
    """Registry settings that a class repeats from an ancestor."""
    own = assignments(facts).where("attr rlike '^_*registry'")
    up = lineage.lineage(facts).select(F.col("descendant").alias("symbol"), "ancestor")
    theirs = own.select(F.col("symbol").alias("ancestor"), "attr", F.col("said").alias("before"))
    same = own.join(up, "symbol").join(theirs, ["ancestor", "attr"]).where("said = before")
    rows = same.dropDuplicates(["symbol", "attr"]).select("path", "line", "owner", F.lit("").alias("func"), F.col("attr").alias("name"))
    return single(rows)


@numbered("D060")
def explicit_priorities(facts, modules, limits):
    """Classes of one base that order themselves by numbers."""
    p = assignments(facts).where("attr in ('priority', 'order', 'rank') and said rlike '^-?[0-9]+$'")
    bases = family(facts, "class").select(F.concat_ws(".", "module", "name").alias("symbol"), F.explode("items").alias("base"))
    rows = p.join(bases, "symbol").select("path", "line", "owner", F.lit("").alias("func"), F.col("attr").alias("name"), "base")
    return grouped(rows, [F.col("base"), F.col("name")], 2)


@numbered("D063")
def transport_shell(facts, modules, limits):
    """A method that builds something of a selector which two or more subclasses set."""
    use = family(facts, "selector_use").where("owner <> ''").select("path", "line", "owner", "func", "name", F.explode("items").alias("attr"))
    bases = family(facts, "class").select(F.concat_ws(".", "module", "name").alias("symbol"), F.explode(F.transform("items", lambda b: F.substring_index(b, ".", -1))).alias("owner"))
    sets = assignments(facts).select("symbol", "attr").distinct().join(bases, "symbol").groupBy("owner", "attr").agg(F.count_distinct("symbol").alias("k")).where(F.col("k") >= limits["min_registration_sites"])
    return single(use.join(sets, ["owner", "attr"], "left_semi"))


@numbered("D070")
def self_cast_mixin(facts, modules, limits):
    """Mixins that cast self to reach attributes, with two or more classes on them."""
    used = family(facts, "class").select(F.explode(F.transform("items", lambda b: F.substring_index(b, ".", -1))).alias("owner"), F.concat_ws(".", "module", "name").alias("c")).groupBy("owner").agg(F.count_distinct("c").alias("k")).where(F.col("k") >= max(2, limits["min_registration_sites"]))
    return single(family(facts, "self_cast").where("owner like '%Mixin' and size(items) >= 1").join(used, "owner", "left_semi"))


@numbered("D073")
def validate_guard_family(facts, modules, limits):
    """Maximal cliques of validate methods that share shape checks, as many as statements that make a duplicate."""
    v = family(facts, "shape_guards").withColumn("id", F.concat_ws(".", "module", "owner"))
    least = max(2, limits["min_duplicate_statements"])
    pairs = matching.overlap_pairs(v.select("id", F.explode("items").alias("guard")), "id", "guard", least)
    groups = search.cliques(pairs, "left_id", "right_id", max(2, limits["min_registration_sites"]))
    each = groups.select("members", "size", F.explode(F.split("members", ",")).alias("id")).join(v.select("id", "path", "line").distinct(), "id")
    return each.groupBy(F.col("members").alias("subject"), F.col("size").alias("n")).agg(F.array_sort(F.collect_list(F.struct("path", "line", F.col("id").alias("symbol")))).alias("evidence"))


@numbered("D077")
def single_consumer_matchers(facts, modules, limits):
    """Public matchers and steps that exactly one other module refers to."""
    c = family(facts, "class").where("name rlike '(Matcher|Grammar|Step)$' and name not like '~_%' escape '~'")
    used = family(facts, "reference").select("name", F.col("path").alias("other")).distinct()
    once = c.select("name", "path", "line", "owner", "func").join(used, "name").where("other <> path").groupBy("path", "line", "owner", "func", "name").agg(F.count_distinct("other").alias("k")).where("k = 1")
    return single(once)


@numbered("D078")
def public_support_functions(facts, modules, limits):
    """Public functions of private modules to which other modules refer."""
    f = family(facts, "function").where("owner = '' and func = '' and not name like '~_%' escape '~' and path rlike '(^|/)_[a-z][^/]*$'")
    used = family(facts, "reference").select("name", F.col("path").alias("other")).distinct()
    met = f.join(used, "name").where("other <> path").dropDuplicates(["path", "line", "name"])
    return grouped(met, [F.col("path")], 1)


@numbered("D079")
def restated_defaults(facts, modules, limits):
    """Calls that give a record what its field has by default."""
    fields = family(facts, "record_class").select(F.col("name").alias("callee"), F.explode("items").alias("f"))
    defaults = fields.select("callee", F.concat_ws("=", F.substring_index("f", ":", 1), F.regexp_extract("f", "=(.*)$", 1)).alias("given")).where("given not like '%='").distinct()
    calls = family(facts, "call_constants").where("value = 'constants'").withColumn("given", F.explode("items")).withColumn("callee", F.col("name"))
    return single(calls.join(defaults, ["callee", "given"]).withColumn("name", F.concat_ws(".", "callee", "given")))


@numbered("D085")
def structural_confusability(facts, modules, limits):
    """Parameters seen only through methods that two or more classes of the module have, without a base in common."""
    seen = family(facts, "observed_methods").select("path", "line", "owner", "func", "name", F.col("value").alias("param"), F.size("items").alias("k"), F.explode("items").alias("m"))
    has = family(facts, "method").select("path", F.col("owner").alias("cls"), F.col("name").alias("m")).distinct()
    fits = seen.join(has, ["path", "m"]).groupBy("path", "line", "owner", "func", "name", "param", "k", "cls").agg(F.count_distinct("m").alias("have")).where("have = k")
    bases = family(facts, "class").where("size(items) > 0").select("path", F.col("name").alias("cls"), F.explode("items").alias("base"))
    shared = fits.join(bases, ["path", "cls"]).groupBy("path", "line", "name", "param", "base").agg(F.count_distinct("cls").alias("c")).where("c >= 2").select("path", "line", "name", "param")
    few = fits.groupBy("path", "line", "owner", "func", "name", "param").agg(F.count_distinct("cls").alias("c")).where("c >= 2").join(shared, ["path", "line", "name", "param"], "left_anti")
    return single(few.withColumn("name", F.concat_ws(".", "name", "param")))


@numbered("D086")
def witness_family(facts, modules, limits):
    """Three or more frozen records of one last word and no base whose fields share three last words or more."""
    r = family(facts, "record_class").where("numbers['frozen'] = 1 and value = ''").withColumn("token", F.regexp_extract("name", "([A-Z][a-z0-9]*)$", 1))
    roles = r.select("path", "token", "name", F.explode(F.transform("items", lambda x: F.substring_index(F.substring_index(x, ":", 1), "_", -1))).alias("role")).distinct()
    size = r.groupBy("path", "token").agg(F.count_distinct("name").alias("k")).where("k >= 3")
    common = roles.groupBy("path", "token", "role").agg(F.count_distinct("name").alias("c")).join(size, ["path", "token"]).where("c = k").groupBy("path", "token").agg(F.count("*").alias("roles")).where("roles >= 3")
    return grouped(r.join(common, ["path", "token"], "left_semi"), [F.col("path"), F.col("token")], 3)


@numbered("D091")
def repeated_declarations(facts, modules, limits):
    """Unrelated classes that assign the same two values or more under the same names."""
    a = assignments(facts).withColumn("atom", F.concat_ws("=", "attr", "said"))
    return class_pairs(facts, unrelated(facts, matching.overlap_pairs(a, "symbol", "atom", 2)))


def sibling_methods(facts: DataFrame, limits: dict) -> DataFrame:
    """Methods of like bodies and one name in two or more classes of one base: (base, name, value, k)."""
    bases = family(facts, "class").select(F.concat_ws(".", "module", "name").alias("cls"), F.explode("items").alias("base"))
    m = owned(facts, "method").where(F.col("numbers")["statements"] >= limits["min_duplicate_statements"])
    return m.join(bases, "cls").select("base", "cls", "path", "line", "owner", "func", "name", "value")


@numbered("D092")
def sibling_overlap(facts, modules, limits):
    """Subclasses of one base with like bodies under one name."""
    return grouped(sibling_methods(facts, limits), [F.col("base"), F.col("name"), F.col("value")], 2, F.count_distinct("cls").alias("classes"), where="classes >= 2")


def overlap_sets(facts: DataFrame, limits: dict) -> DataFrame:
    """(base, name, members): which classes share a method's body."""
    sets = sibling_methods(facts, limits).groupBy("base", "name", "value").agg(F.array_sort(F.collect_set("cls")).alias("members"), F.min(F.struct("path", "line")).alias("at")).where("size(members) >= 2")
    return sets.select("base", "name", "members", "at")


@numbered("D093")
def sibling_overlap_family(facts, modules, limits):
    """The same subclasses share the bodies of two methods or more."""
    return overlap_sets(facts, limits).groupBy("base", "members").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n >= 2").select("base", F.concat_ws(" | ", "base", F.array_join("members", ",")).alias("subject"), "n", F.array(F.struct("at.path", "at.line", F.col("base").alias("symbol"))).alias("evidence")).drop("base")


@numbered("D094")
def inheritance_lattice(facts, modules, limits):
    """Bases under which one set of sharing subclasses lies strictly inside another."""
    sets = overlap_sets(facts, limits).select("base", "members", "at").dropDuplicates(["base", "members"])
    a, b = sets.select("base", F.col("members").alias("x"), "at"), sets.select("base", F.col("members").alias("y"))
    edges = a.join(b, "base").where("size(x) < size(y) and size(array_except(x, y)) = 0")
    return edges.groupBy(F.col("base").alias("subject")).agg(F.count("*").alias("n"), F.min("at").alias("at")).select("subject", "n", F.array(F.struct("at.path", "at.line", F.col("subject").alias("symbol"))).alias("evidence"))


@numbered("D114")
def companion_records(facts, modules, limits):
    """Records of one module of which one bears the other's name and two or more of its typed fields."""
    r = named(facts, "record_class").select("id", F.explode(F.transform("items", lambda x: F.regexp_replace(x, "=[^=]*$", ""))).alias("f"))
    pairs = matching.overlap_pairs(r, "id", "f", 2).where(path_of("left_id") == path_of("right_id"))
    a, b = F.substring_index("left_id", ":", -1), F.substring_index("right_id", ":", -1)
    return pair_rows(pairs.where(a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a)))


@numbered("D116")
def boundary_local_wrappers(facts, modules, limits):
    """Functions that only pass on to a constructor, where its fields are forwarded in four places or more."""
    wrap = family(facts, "constructor_return").where("owner = ''")
    spread = family(facts, "forwarded").groupBy("path", F.col("name").alias("word")).agg(F.count("*").alias("k")).where(F.col("k") >= limits["min_boundary_fanout_sites"])
    return single(wrap.withColumn("word", F.explode("items")).join(spread, ["path", "word"]).dropDuplicates(["path", "line", "name"]))


@numbered("D117")
def facade_only(facts, modules, limits):
    """Classes of which every public method, two or more, only passes on to something private."""
    own = owned(facts, "private_delegate").where("owner <> ''")
    total = owned(facts, "method").where("not name like '~_%' escape '~'").groupBy("cls").agg(F.count("*").alias("public"))
    passing = own.groupBy("cls").agg(F.count("*").alias("k")).join(total, "cls").where("k = public and k >= 2")
    return grouped(own.join(passing, "cls", "left_semi"), [F.col("cls")], 2)


def subsets_of_registry(facts: DataFrame) -> DataFrame:
    """Lists of two strings or more that are all keys of a registry of the same module."""
    keys = family(facts, "registration").where("value <> 'call' and value <> 'decorator'").select("path", F.col("name").alias("registry"), F.regexp_replace("value", "^['\"]|['\"]$", "").alias("key")).distinct()
    lists = family(facts, "string_list").where("size(items) >= 2").select("path", "line", "owner", "func", "name", F.size("items").alias("k"), F.explode("items").alias("key"))
    met = lists.join(keys, ["path", "key"]).groupBy("path", "line", "owner", "func", "name", "registry", "k").agg(F.count_distinct("key").alias("have"))
    return met.where("have = k")


@numbered("D132")
def registry_projections(facts, modules, limits):
    """Lists of a registry's keys written by hand."""
    return single(subsets_of_registry(facts))


@numbered("D133")
def registry_policies(facts, modules, limits):
    """Registries with two such lists or more."""
    return grouped(subsets_of_registry(facts), [F.col("path"), F.col("registry")], 2)


@numbered("D134")
def premature_registry(facts, modules, limits):
    """Registries with one entry."""
    r = family(facts, "registration")
    alone = r.groupBy("path", "name").agg(F.count("*").alias("k")).where("k = 1").select("path", "name")
    return single(r.join(alone, ["path", "name"], "left_semi"))


@numbered("D146")
def schema_registry_mirror(facts, modules, limits):
    """Tables or rows of a module whose keys are exactly the fields of a record of it."""
    own = family(facts, "record_class").select("path", F.col("name").alias("record"), F.array_join(F.array_sort(F.transform("items", lambda x: F.substring_index(x, ":", 1))), ",").alias("keys"))
    t = family(facts, "keyed_rows").where("size(items) >= 2").withColumn("keys", F.array_join("items", ","))
    return single(t.join(own, ["path", "keys"]).withColumn("name", F.concat_ws("~", "name", "record")))


@numbered("D172")
def namespace_mirror(facts, modules, limits):
    """Records that read a namespace field by field, with two of the fields or more in a list of arguments."""
    own = family(facts, "namespace_class").select("path", "line", "owner", "func", "name", F.explode("items").alias("field"))
    flags = family(facts, "keyed_rows").where("value = 'rows'").select(F.explode("items").alias("flag")).select(F.translate(F.regexp_replace("flag", "^-+", ""), "-", "_").alias("field")).distinct()
    met = own.join(flags, "field").groupBy("path", "line", "owner", "func", "name").agg(F.count_distinct("field").alias("k")).where("k >= 2")
    return single(met)


def snake(name: Column, ending: str) -> Column:
    return names.normalized(F.regexp_replace(name, ending + "$", ""))


@numbered("D154")
def derivable_ids(facts, modules, limits):
    """Detector ids that say the class's own name."""
    a = assignments(facts).where("attr = 'detector_id'")
    same = a.where(F.regexp_replace("said", "^['\"]|['\"]$", "") == snake(F.col("owner"), "Detector"))
    return single(same.select("path", "line", "owner", F.lit("").alias("func"), F.col("attr").alias("name")))


@numbered("D155")
def derivable_collectors(facts, modules, limits):
    """Collectors named after the class that declares them."""
    a = assignments(facts).where("attr = 'candidate_collector'")
    same = a.where(F.col("said") == F.concat(F.lit("_"), snake(F.col("owner"), "Detector"), F.lit("_candidates")))
    return single(same.select("path", "line", "owner", F.lit("").alias("func"), F.col("attr").alias("name")))


@numbered("D165")
def conversion_matrix(facts, modules, limits):
    """Functions x_to_y of a module that fill a grid of two sources and two targets or more."""
    f = family(facts, "function").where("owner = ''").withColumn("src", F.regexp_extract("name", "^([a-z0-9]+)_to_([a-z0-9]+)$", 1)).withColumn("dst", F.regexp_extract("name", "^([a-z0-9]+)_to_([a-z0-9]+)$", 2)).where("src <> ''")
    return grouped(f, [F.col("path")], 4, F.count_distinct("src").alias("s"), F.count_distinct("dst").alias("d"), F.count_distinct("name").alias("cells"), where="s >= 2 and d >= 2 and cells = s * d")


@numbered("D005")
def role_surface_drift(facts, modules, limits):
    """Fields forwarded twice or more under one other word that their own name does not have."""
    declared_by = owned(facts, "field").groupBy("name").agg(F.count_distinct("cls").alias("d"))
    uses = family(facts, "forwarded").withColumn("field", F.substring_index("value", ".", -1)).where("value like '%.%'")
    met = uses.join(declared_by.withColumnRenamed("name", "field"), "field").withColumn("new", F.array_except(names.tokens(F.col("name")), names.tokens(F.col("field")))).where("size(new) > 0")
    return grouped(met.withColumn("token", F.explode("new")), [F.col("field"), F.col("token")], max(limits["min_role_drift_use_sites"], limits["min_role_drift_token_support"]))


@numbered("D006")
def role_case_tables(facts, modules, limits):
    """Functions of several owners, under one broad word, that compare with the same two strings or more."""
    s = family(facts, "role_cases").withColumn("by", F.concat_ws(".", "module", "owner", "name"))
    cases = s.select("by", F.col("value").alias("broad"), F.explode("items").alias("case")).distinct()
    often = cases.groupBy("broad", "case").agg(F.count_distinct("by").alias("owners")).where(F.col("owners") >= limits["min_generic_role_case_table_owners"])
    enough = often.groupBy("broad").agg(F.count("*").alias("k")).where(F.col("k") >= limits["min_generic_role_case_table_cases"])
    return grouped(s.withColumnRenamed("value", "broad").join(enough, "broad", "left_semi"), [F.col("broad")], limits["min_generic_role_case_table_owners"])


@numbered("D007")
def local_role_cases(facts, modules, limits):
    """A function that compares with two strings or more."""
    return single(family(facts, "role_cases").where(F.size("items") >= limits["min_local_role_case_logic_cases"]))

