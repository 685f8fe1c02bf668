"""Rules over paths and lint over texts: first matching rule, shadowed rules, required fields, detectors with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.text import trailing_blank_lines
from vaultspark.operators.predicates import elements, glob_regex, member, present, text_of


def first_rule(path: Column, globs: list[str]) -> Column:
    """Number of the first glob that matches, null without one. Rules are few and known when the plan is made, so the
    theta join with them is one expression: no join, no shuffle."""
    out = None
    for i, g in enumerate(globs):
        test = path.rlike(glob_regex(g, stars_cross=False))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def first_rule_by_table(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, rule): the same with rules (rule, regex) in a table; only the least rule number of each path is shuffled."""
    hit = paths.join(rules, F.expr("path rlike regex"), "left")
    return hit.groupBy("path").agg(F.min("rule").alias("rule"))


def sample_path(glob: str) -> str:
    """A path that a glob matches."""
    return glob.replace("**/", "d/").replace("**", "d/x").replace("*", "x").replace("?", "x")


def shadowed_rules(spark, globs: list[str]) -> DataFrame:
    """(rule, by): rules that can't come into effect, since an earlier one matches a path they are made for."""
    rows = [(i, sample_path(g), glob_regex(g, stars_cross=False)) for i, g in enumerate(globs)]
    r = spark.createDataFrame(rows, "rule int, sample string, regex string")
    e = r.select(F.col("rule").alias("by"), F.col("regex").alias("earlier"))
    return r.join(e, F.expr("by < rule and sample rlike earlier")).groupBy("rule").agg(F.min("by").alias("by"))


def missing_fields(fm: Column, required: list[str]) -> Column:
    """array<string>: required keys that are missing, null or blank."""
    blank = lambda k: ~present(member(fm, k)) | F.coalesce(F.trim(text_of(member(fm, k))) == "", F.lit(False))
    return F.array_compact(F.array(*[F.when(blank(k), F.lit(k)) for k in required])) if required else F.array().cast("array<string>")


def classify(notes: DataFrame, rules: list[dict]) -> DataFrame:
    """(path, rule, expected, found, missing, ok) by the first of the rules {match, okf_type, required, enforcement} that fits.

    enforcement: 'exempt' notes are always ok, 'soft' ones report but are ok, 'hard' ones are ok without violations.
    Notes without a rule are ok.
    """
    n = notes.withColumn("rule", first_rule(F.col("path"), [r["match"] for r in rules]))
    pick = lambda f: F.coalesce(*[F.when(F.col("rule") == i, f(r)) for i, r in enumerate(rules)]) if rules else F.lit(None)
    expected = pick(lambda r: F.lit(r.get("okf_type")).cast("string"))
    missing = F.coalesce(pick(lambda r: missing_fields(F.col("fm"), list(r.get("required") or []))), F.array().cast("array<string>"))
    found = text_of(member(F.col("fm"), "okf_type"))
    mode = F.coalesce(pick(lambda r: F.lit(r.get("enforcement", "hard"))), F.lit("exempt"))
    n = n.select("path", "rule", expected.alias("expected"), found.alias("found"), missing.alias("missing"), mode.alias("mode"))
    clean = (F.size("missing") == 0) & (F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("found")))
    return n.select("path", "rule", "expected", "found", "missing", (F.col("mode").isin("exempt", "soft") | clean).alias("ok"))


def dry_run(notes: DataFrame, old: list[dict], new: list[dict]) -> DataFrame:
    """(path, old_rule, new_rule, new_missing): notes that another rule set classifies otherwise or finds more missing in.

    Both classifications are projections of one scan: nothing is joined.
    """
    n = notes.select("path", "fm", first_rule(F.col("path"), [r["match"] for r in old]).alias("old_rule"), first_rule(F.col("path"), [r["match"] for r in new]).alias("new_rule"))
    per = lambda rules, c: F.coalesce(*[F.when(F.col(c) == i, missing_fields(F.col("fm"), list(r.get("required") or []))) for i, r in enumerate(rules)], F.array().cast("array<string>"))
    n = n.select("path", "old_rule", "new_rule", F.array_except(per(new, "new_rule"), per(old, "old_rule")).alias("new_missing"))
    return n.where(~F.col("old_rule").eqNullSafe(F.col("new_rule")) | (F.size("new_missing") > 0))


def flaws(notes: DataFrame, required: list[str] | None = None, folders: list[str] | None = None, link_states: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(path, code, detail): what detectors find in notes (path, text, perhaps fm). Detectors are projections, united.

    trailing_blanks, no_final_newline, callout (an admonition in a quote), unexpected_folder, missing_field, broken_link.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    found = [
        F.when(trailing_blank_lines(t) > 0, F.struct(F.lit("trailing_blanks").alias("code"), trailing_blank_lines(t).cast("string").alias("detail"))),
        F.when((t != "") & ~t.endswith("\n"), F.struct(F.lit("no_final_newline").alias("code"), F.lit("").alias("detail"))),
        F.when(t.rlike(r"(?m)^>\s*\[!"), F.struct(F.lit("callout").alias("code"), F.lit("").alias("detail"))),
    ]
    if folders is not None:
        top = F.element_at(F.split("path", "/"), 1)
        found.append(F.when(F.col("path").contains("/") & ~top.isin(folders), F.struct(F.lit("unexpected_folder").alias("code"), top.alias("detail"))))
    out = notes.select("path", F.explode(F.array_compact(F.array(*found))).alias("f")).select("path", "f.*")
    if required:
        out = out.unionByName(notes.select("path", F.explode(missing_fields(F.col("fm"), required)).alias("detail")).withColumn("code", F.lit("missing_field")))
    if link_states is not None and links is not None:
        bad = links.join(link_states.where("state <> 'ok'").select("key", "state"), "key")
        out = out.unionByName(bad.select(F.col("source").alias("path"), F.concat("state", F.lit("_link")).alias("code"), F.col("key").alias("detail")))
    return out


def profile_flaws(notes: DataFrame, field: str, required: list[str], statuses: list[str] | None = None, status: str = "status") -> DataFrame:
    """(path, place, code) of notes (path, fm) whose list of maps `field` breaks its profile.

    not_a_list (place -1) if the field is there but no list; per element, by place: not_a_map, missing_<key> for a required key
    that is absent (a null is there), bad_status for one that is neither null nor among statuses.
    """
    v = member(F.col("fm"), field)
    items = elements(v)
    no_list = notes.where(v.isNotNull() & items.isNull()).select("path", F.lit(-1).alias("place"), F.lit("not_a_list").alias("code"))
    each = notes.select("path", F.posexplode(items).alias("place", "item"))
    is_map = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    tests = [F.when(~is_map, F.lit("not_a_map")), *[F.when(is_map & member(F.col("item"), k).isNull(), F.lit(f"missing_{k}")) for k in required]]
    if statuses:
        tests.append(F.when(is_map & present(member(F.col("item"), status)) & ~text_of(member(F.col("item"), status)).isin(statuses), F.lit("bad_status")))
    return no_list.unionByName(each.select("path", "place", F.explode(F.array_compact(F.array(*tests))).alias("code")))


def flaw_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_notes"))


def reprojection_due(contracts: DataFrame, stamp: str | None) -> bool:
    """Whether contracts (path, mtime) changed since a stamp, which is their sum of hashes."""
    return contracts_stamp(contracts) != stamp


def contracts_stamp(contracts: DataFrame) -> str:
    r = contracts.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "mtime").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h']}"


def override(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of primary, and those of fallback whose key primary lacks."""
    rows = primary.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_p")
    return rows.withColumn("_rn", F.rank().over(w)).where("_rn = 1").drop("_p", "_rn")
