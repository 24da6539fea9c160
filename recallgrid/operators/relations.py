"""The closed relation vocabulary: exact names, inverse names that turn an edge round, then ordered stems, else RELATED_TO."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: canonical relation: the names that mean it
NAMES = {
    "ABOUT": "about mentioned",
    "AFFILIATED_WITH": "affiliated_with founded_with",
    "APPLIED_TO": "applied_for applied_to interviewed_at interviewed_by interviewed_for interviewed_with interviewing_with",
    "ATTENDS": "attended attends graduated_from student_at studies_at",
    "CLIENT_OF": "client_of customer_of",
    "CONTACTED": "contacted met met_with reached_out_to",
    "CONTACT_AT": "contact_at has_point_of_contact poc_for point_of_contact",
    "DEPLOYS": "deployment_of deploys",
    "FOUNDED": "co_founded co_founder_of cofounded cofounder_of founded founder_of",
    "HAS_PROJECT": "building has_project worked_on works_on",
    "HIRING": "has_job has_job_opening has_job_posting hiring hiring_for offers_job offers_role posted posted_job",
    "INSTANCE_OF": "instance_of",
    "INTERESTED_IN": "evaluating interested_in wants",
    "INVOLVES": "involves",
    "IN_INDUSTRY": "category in_industry industry sector",
    "LEADS": "ceo_of cfo_of coo_of cto_of director_of leads manages runs",
    "LIVES_IN": "lives_in resides_in",
    "LOCATED_IN": """at_location based_in for_positions_in has_job_posting_in headquartered_in in_city in_location is_located_in is_location
        located_in location location_of_job_opening offered_in offers_hybrid_in offers_onsite_in operates_in search_location serves work_location""",
    "MEMBER_OF": "member_of",
    "OFFERS": "offers provides sells",
    "OWES": "has_outstanding_invoice owes",
    "OWNS": "acquired equity_holder owner_of owns",
    "PARENT_OF": "father_of mother_of parent_of",
    "PARTNER_OF": "boyfriend_of dating distributor_for girlfriend_of in_relationship_with partner_of reseller_of",
    "PART_OF": "part_of",
    "POSSIBLE_ALIAS": "possible_alias",
    "POSTED_ON": "posted_on",
    "PROSPECT": "lead potential_client prospect prospect_of",
    "REFERRAL_FROM": "referral_from referred_by",
    "RELATED_TO": "application_deadline application_deadline_is effective_date expires_on has_salary related_to",
    "SIBLING_OF": "sibling_of",
    "SPOUSE_OF": "married_to spouse_of",
    "STEP_CHILD_OF": "step_child_of",
    "TARGETS": "targets",
    "TRAVELS_TO": "travels_to",
    "USES": "applied_via built_with uses uses_stack uses_tool",
    "VENDOR_OF": "supplier_of vendor_of",
    "WORKS_FOR": "employed_by employee_of recruiter_at recruiter_for staff_of works_at works_for",
}
#: the same for names that say it from the other end
INVERSE = {
    "FOUNDED": "co_founded_by founded_by",
    "HIRING": "is_role_at job_posted_by posted_by role_at",
    "LEADS": "has_ceo has_cto led_by managed_by run_by",
    "OFFERS": "developed_by issued_by offered_by operated_by provided_by",
    "OWNS": "owned_by",
    "PARENT_OF": "child_of",
    "WORKS_FOR": "employer_of employs",
}
#: tried from the top
STEMS = [
    ("LOCATED_IN", "address based headquarter locat"),
    ("APPLIED_TO", "appli apply"),
    ("HIRING", "hiring job position recruit vacanc"),
    ("POSTED_ON", "post"),
    ("AFFILIATED_WITH", "co_founder cofounder"),
    ("WORKS_FOR", "employ staff work"),
    ("FOUNDED", "found"),
    ("CONTACTED", "contact email reached"),
    ("ATTENDS", "attend enroll graduat stud"),
    ("OWNS", "own"),
    ("LEADS", "ceo director lead manag"),
    ("PARTNER_OF", "partner"),
    ("OFFERS", "offer provid sell"),
    ("MEMBER_OF", "member"),
    ("TRAVELS_TO", "travel visit"),
    ("USES", "deploy use"),
    ("INTERESTED_IN", "interest"),
]
OTHER = "RELATED_TO"


def _map(table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for canonical, names in table.items() for name in names.split() for x in (name, canonical)]
    return F.create_map(*pairs)


def snake(relation: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(relation)), "[^a-z0-9]+", "_"), F.lit("_"))


def canonical(relation: Column) -> Column:
    """struct<canonical, flipped>; flipped tells that source and target change places. Null and empty names give the rest class."""
    name = snake(relation)
    stem = F.lit(OTHER)
    for target, stems in reversed(STEMS):
        stem = F.when(name.rlike("|".join(stems.split())), target).otherwise(stem)
    ruled = name.rlike("|".join([s for _, group in STEMS for s in group.split()] + "date deadline notif receiv salary sent updat via".split()))
    exact, inverse = F.try_element_at(_map(NAMES), name), F.try_element_at(_map(INVERSE), name)
    empty = relation.isNull() | (relation == "")
    result = F.when(empty, OTHER).otherwise(F.coalesce(exact, inverse, stem))
    flipped = ~empty & exact.isNull() & (inverse.isNotNull() | (ruled & name.endswith("_by")))
    return F.struct(result.alias("canonical"), F.coalesce(flipped, F.lit(False)).alias("flipped"))


def changed(relation: Column, mapped: Column) -> Column:
    """Whether the stored relation differs from what was said, so that the original is worth keeping."""
    return mapped["flipped"] | (mapped["canonical"] != F.regexp_replace(F.upper(relation), " ", "_"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges with canonical relations, turned round where the name is inverse, the name as said in rel_orig where it differs; self-edges drop."""
    out = edges.withColumn("__m", canonical(F.col("rel")))
    turn = F.col("__m.flipped")
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst", "rel_orig")]
    out = out.select(
        F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.col("__m.canonical").alias("rel"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(changed(F.col("rel"), F.col("__m")), F.col("rel")).otherwise("").alias("rel_orig"), *rest)
    return out.where("src <> dst")


#: Edges that upkeep wrote, and relations that review reads, keep their names.
SYSTEM_TAGS = ("alias-candidate", "calendar", "chunk", "proposed", "rejected")
SYSTEM_RELATIONS = ("INSTANCE_OF", "POSSIBLE_ALIAS")


def remap(edges: DataFrame, system: tuple[str, ...] = SYSTEM_TAGS) -> DataFrame:
    """A store brought to the vocabulary: on collision a row that was canonical already stays, then the earlier one. Applying it twice changes nothing."""
    own = (F.col("src_tag").isNull() | ~F.col("src_tag").isin(*system)) & ~F.col("rel").isin(*SYSTEM_RELATIONS)
    kept = edges.where(~own)
    kept = kept if "rel_orig" in kept.columns else kept.withColumn("rel_orig", F.lit(""))
    old = edges.where(own).withColumn("__same", ~changed(F.col("rel"), canonical(F.col("rel"))))
    keep = F.col("rel_orig") if "rel_orig" in edges.columns else F.lit("")
    mapped = canonical_edges(old.withColumn("__said", keep)).withColumn("rel_orig", F.when(F.col("__said") != "", F.col("__said")).otherwise(F.col("rel_orig"))).drop("__said")
    both = mapped.unionByName(kept.withColumn("__same", F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("src", "rel", "dst").orderBy(F.desc("__same"), "seq"))
    return both.withColumn("__n", rank).where("__n = 1").drop("__n", "__same")


def mapping(edges: DataFrame) -> DataFrame:
    m = canonical(F.col("rel"))
    return edges.withColumn("m", m).groupBy("rel", F.col("m.canonical").alias("canonical"), F.col("m.flipped").alias("flipped")).agg(F.count("*").alias("n"))
