"""Keyed merges for plain Parquet tables: existing rows, incoming rows, one rule per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def merge_into(existing: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Full outer merge on keys. Rules: replace (default: new wins if the row is incoming), keep (old wins), coalesce_old (old unless null)."""
    rules = rules or {}
    a = existing.select(*(F.col(c).alias(f"o_{c}") for c in existing.columns), F.lit(True).alias("o__"))
    b = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns), F.lit(True).alias("n__"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    out = []
    for c in existing.columns:
        old, new = F.col(f"o_{c}"), F.col(f"n_{c}") if c in incoming.columns else F.lit(None)
        rule = rules.get(c, "replace")
        if rule == "keep":
            value = F.when(F.col("o__"), old).otherwise(new)
        elif rule == "coalesce_old":
            value = F.coalesce(old, new)
        else:
            value = F.when(F.col("n__"), new).otherwise(old) if c in incoming.columns else old
        out.append(value.alias(c))
    return joined.select(*out)


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the largest `by`; ties go by the other columns, in their order, largest first."""
    order = [F.desc(by), *(F.desc(c) for c in rows.columns if c != by and c not in keys)]
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


REASON_CHARS = 500  # of an error or a reason that is kept


def settle(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sets status, decided_at and decided_by and merges keys into the JSON meta: outcomes(id, status, at, by, patch).

    A key of patch takes the place of meta's; values keep their JSON type, and texts named error or reason are cut.
    """
    kind = "map<string,variant>"
    ledger = ledger if "decided_by" in ledger.columns else ledger.withColumn("decided_by", F.lit(None).cast("string"))
    joined = ledger.join(outcomes.select("id", F.col("status").alias("s"), F.col("at"), F.col("by"), F.col("patch")), "id", "left")
    old, new = F.coalesce(F.from_json("meta", kind), F.expr("map()").cast(kind)), F.coalesce(F.from_json("patch", kind), F.expr("map()").cast(kind))
    cut = F.transform_values(new, lambda k, v: F.when(k.isin("error", "reason"), F.parse_json(F.to_json(F.substring(F.try_variant_get(v, "$", "string"), 1, REASON_CHARS).cast("variant")))).otherwise(v))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), cut)
    done = F.col("s").isNotNull()
    out = joined.withColumn("meta", F.when(done, F.to_json(merged)).otherwise(F.col("meta")))
    out = out.withColumns({"status": F.coalesce("s", "status"), "decided_at": F.when(done, F.col("at")).otherwise(F.col("decided_at")), "decided_by": F.when(done, F.col("by")).otherwise(F.col("decided_by"))})
    return out.drop("s", "at", "by", "patch")


def replace_days(existing: DataFrame, incoming: DataFrame, day: str = "date") -> DataFrame:
    """existing with all rows of the days that incoming has replaced by it: a run of the same day leaves no second one."""
    return existing.join(incoming.select(day).distinct(), day, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def replace_if_any(existing: DataFrame, incoming: DataFrame, stamp, as_of, max_age_days: int = 7) -> tuple[DataFrame, bool]:
    """(the table to keep, whether it is the new one): not before the old one has its age, and never by an empty one."""
    young = stamp is not None and (as_of - stamp).days < max_age_days
    fresh = not young and not incoming.isEmpty()
    return (incoming if fresh else existing), fresh


def insert_planned(ledger: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """ledger and items as planned rows of their own, with ids that go on from its largest, in the order of title and kind.

    Items are what one run plans: few, and ranked in one window.
    """
    start = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    ranked = items.withColumn("__n", F.row_number().over(W.orderBy("title", "kind")))
    rows = ranked.crossJoin(F.broadcast(start)).withColumns({"id": (F.col("__last") + F.col("__n")).cast("long"), "status": F.lit("planned"), "created": F.lit(as_of)})
    kept = [F.col(c) if c in rows.columns else F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns]
    return ledger.unionByName(rows.select(*kept))


def merge_targets(targets: DataFrame, found: DataFrame, now) -> DataFrame:
    """targets after a run that found(url, domain, title, citations, score, competitors, listed), with `outcome`.

    A new target is listed or new; a known one takes what was measured and keeps its state, unless it became listed,
    which only goes forward: listed_at keeps the first time. outcome: added, newly_listed, seen, or null if not found.
    """
    old = targets.select(*(F.col(c).alias(c if c == "url" else f"o_{c}") for c in targets.columns), F.lit(True).alias("o_"))
    new = found.select(*(F.col(c).alias(c if c == "url" else f"n_{c}") for c in found.columns), F.lit(True).alias("n_"))
    both, at = old.join(new, "url", "full_outer"), F.lit(now)
    is_new, seen, listed = F.col("o_").isNull(), F.col("n_").isNotNull(), F.coalesce("n_listed", F.lit(False))
    turned = seen & listed & (F.coalesce("o_state", F.lit("")) != "listed")
    measured = lambda c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    values = {
        "domain": F.coalesce("o_domain", "n_domain"), "first_seen": F.coalesce("o_first_seen", at), "last_seen": F.when(seen, at).otherwise(F.col("o_last_seen")),
        "state": F.when(turned, "listed").otherwise(F.coalesce("o_state", F.lit("new"))), "state_changed": F.when(is_new | turned, at).otherwise(F.col("o_state_changed")),
        "listed_at": F.when(turned, F.coalesce("o_listed_at", at)).otherwise(F.col("o_listed_at")), **{c: measured(c) for c in ("title", "citations", "score", "competitors")},
    }
    outcome = F.when(is_new, "added").when(turned, "newly_listed").when(seen, "seen")
    return both.select("url", *(v.alias(c) for c, v in values.items()), outcome.alias("outcome"))


def target_counts(merged: DataFrame) -> DataFrame:
    """One row of merge_targets(): how many were seen, added and newly listed."""
    return merged.agg(F.count("outcome").alias("seen"), F.count_if(F.col("outcome") == "added").alias("added"), F.count_if(F.col("outcome") == "newly_listed").alias("newly_listed"))


def repair_domains(citations: DataFrame, redirect_host: str = "redirect.example.net") -> DataFrame:
    """citations whose domain is the redirect host's with the domain that their title names, where it looks like one."""
    named = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    is_host = (named != "") & F.contains(named, F.lit(".")) & ~F.contains(named, F.lit(" ")) & ~F.contains(named, F.lit("/"))
    wrong = F.contains("domain", F.lit(redirect_host)) & is_host
    return citations.withColumn("domain", F.when(wrong, F.regexp_replace(named, r"^www\.", "")).otherwise(F.col("domain")))


def set_state(targets: DataFrame, updates: DataFrame, allowed=("contacted", "declined", "skipped")) -> tuple[DataFrame, DataFrame]:
    """(targets with allowed updates(url, state) applied, updates refused for their state or an unknown url)."""
    good = updates.where(F.col("state").isin(*allowed))
    refused = updates.where(~F.col("state").isin(*allowed)).union(good.join(targets, "url", "left_anti"))
    return merge_into(targets, good.join(targets.select("url"), "url", "left_semi"), ["url"]), refused
