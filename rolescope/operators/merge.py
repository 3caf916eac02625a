"""Table changes as pure functions: old table and changes in, new table out.

Every join is on a table's own key, where rows are unique and spread evenly. The caller writes the
result to a new place; nothing here overwrites what it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.functions.normalize import to_uuid
from rolescope.functions.words import or_empty
from rolescope.operators.dedup import first_wins, new_by_key
from rolescope.operators.filters import reject_reason
from rolescope.rules import Rules
from rolescope.schemas import IMPORT_PATCH_COLUMNS

# Defaults of a new state row, and batch states that are still active.
NEW_STATUS = "New"
ACTIVE = ("queued", "running")


def folded(rows: DataFrame, key: str, **picks: tuple[Column, Column]) -> DataFrame:
    """One row per key with the picks {name: (value, order)}: the value at the least order, nulls in order left out.

    This is a map-side aggregate, so a key with very many changes is cut down before it is shuffled.
    """
    return rows.groupBy(key).agg(*[F.min_by(value, order).alias(name) for name, (value, order) in picks.items()])


def _whole(rows: DataFrame) -> Column:
    return F.struct(*rows.columns)


def _first(order: Sequence[str], where: Column | None = None) -> Column:
    place = F.struct(*order)
    return place if where is None else F.when(where, place)


def _last(rows: DataFrame, key: str, order: Sequence[str], **where: Column) -> DataFrame:
    """Per key the last row as ``_new``, and for each ``name=condition`` the last row that meets it as ``name``."""
    place = F.struct(*order)
    last = [F.max_by(_whole(rows), place).alias("_new")]
    last += [F.max_by(_whole(rows), F.when(condition, place)).alias(name) for name, condition in where.items()]
    return rows.groupBy(key).agg(*last)


def insert_absent(table: DataFrame, rows: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """Keep stored rows; add those whose key is new, the first by ``order`` where a key repeats.

    Rows alike in ``order`` must be alike. Columns that only order are not added to the table.
    """
    first = folded(rows, key, _new=(_whole(rows), _first(order))).join(table.select(key), key, "left_anti")
    added = first.select("_new.*").drop(*[name for name in order if name not in table.columns])
    return table.unionByName(added, allowMissingColumns=True)


def _both(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """Stored rows beside their changes (one row per key), then changes of new keys: no full outer join, so that
    the engine may broadcast a small batch of changes and leave the stored table where it is."""
    left = old.select(key, F.struct(*old.columns).alias("_old"))
    added = new.join(old.select(key), key, "left_anti").withColumn("_old", F.lit(None).cast(left.schema["_old"].dataType))
    joined = left.join(new, key, "left").unionByName(added)
    return joined, F.col("_old").isNotNull(), F.col("_new").isNotNull()


def upgrade_scores(table: DataFrame, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Insert new jobs. A stored job only takes over the four scoring columns, and only while it has no
    model reasoning and the incoming row has one.

    Where an id repeats, the rows count in ``order``, as if they came one after the other: the first inserts,
    the first with reasoning upgrades.
    """
    scoring = ("score", "tier", "ai_reasoning", "regex_score")
    reasoned = F.col("ai_reasoning").isNotNull()
    changes = folded(rows, "id", _new=(_whole(rows), _first(order)), _up=(_whole(rows), _first(order, reasoned)))
    joined, stored, _ = _both(table, changes, "id")
    base = {name: F.when(stored, F.col(f"_old.{name}")).otherwise(F.col(f"_new.{name}") if name in rows.columns else F.lit(None))
            for name in table.columns}
    upgrade = base["ai_reasoning"].isNull() & F.col("_up").isNotNull()

    def pick(name: str) -> Column:
        if name in scoring:
            return F.when(upgrade, F.col(f"_up.{name}") if name in rows.columns else F.lit(None)).otherwise(base[name])
        return base[name]
    return joined.select("id", *[pick(name).alias(name) for name in table.columns if name != "id"])


def upsert_state(table: DataFrame, rows: DataFrame, at: Column, order: Sequence[str]) -> DataFrame:
    """Overwrite every state field with the new row's, except that a missing pdf_path keeps the old one.

    Rows without a status get ``New``, rows without timestamps an empty map. Without a ``pdf_path``
    column in ``rows`` this is the bulk variant. Where an id repeats, its last row by ``order`` counts, and
    its last pdf_path.
    """
    filed = {"_filed": F.col("pdf_path").isNotNull()} if "pdf_path" in rows.columns else {}
    joined, _, changed = _both(table, _last(rows, "job_id", order, **filed), "job_id")

    def incoming(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast(table.schema[name].dataType)
        return F.col(f"_new.{name}")

    def pick(name: str) -> Column:
        new = incoming(name)
        if name == "status":
            new = F.coalesce(new, F.lit(NEW_STATUS))
        elif name == "timestamps":
            new = F.coalesce(new, F.create_map().cast(table.schema[name].dataType))
        elif name == "pdf_path":
            new = F.coalesce(F.col("_filed.pdf_path") if filed else new, F.col("_old.pdf_path"))
        elif name == "updated_at":
            new = at
        return F.when(changed, new).otherwise(F.col(f"_old.{name}")).alias(name)
    return joined.select("job_id", *[pick(name) for name in table.columns if name != "job_id"])


def default_states(table: DataFrame, jobs: DataFrame, at: Column) -> DataFrame:
    """Add a default state row for every job that has none, one however often the job is listed."""
    fresh = jobs.select(F.col("id").alias("job_id")).distinct().join(table.select("job_id"), "job_id", "left_anti")
    defaults = {"status": F.lit(NEW_STATUS), "updated_at": at}
    for field in table.schema.fields:
        if field.name == "timestamps":
            defaults[field.name] = F.create_map().cast(field.dataType)
        elif field.name not in ("job_id", *defaults):
            defaults[field.name] = F.lit(None).cast(field.dataType)
    return table.unionByName(fresh.withColumns({name: value for name, value in defaults.items()
                                                if name in table.columns}))


def upsert_cache(table: DataFrame, rows: DataFrame, at: Column, order: Sequence[str]) -> DataFrame:
    """Company cache: new rows replace stored ones of the same key, the last by ``order``, and refresh ``cached_at``."""
    changes = _last(rows, "company_name", order)
    joined, _, changed = _both(table, changes, "company_name")

    def new(name: str) -> Column:
        return at if name == "cached_at" else F.col(f"_new.{name}") if name in rows.columns else F.lit(None)
    return joined.select("company_name", *[
        F.when(changed, new(name)).otherwise(F.col(f"_old.{name}")).alias(name)
        for name in table.columns if name != "company_name"
    ])


def company_lookup(cache: DataFrame) -> DataFrame:
    """The cache by lower-case key, empty text for missing fields."""
    return cache.select(
        F.lower("company_name").alias("key"), F.col("company_name").alias("name"),
        *[or_empty(F.col(name)).alias(name) for name in ("summary", "logo_url", "industry")],
    )


def replace_plans(plans: DataFrame, plan_jobs: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and their jobs after a full replacement.

    Ids become UUIDs, jobs that do not exist drop out, and the first of a repeated (plan, job) wins.
    ``plan_jobs`` holds plan_id, job_id, notes and pos.
    """
    kept = plan_jobs.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    once = first_wins(kept, ["plan_id", "job_id"], ["pos"])
    return (
        plans.withColumn("id", to_uuid(F.col("id"))),
        once.select(to_uuid(F.col("plan_id")).alias("plan_id"), "job_id", or_empty(F.col("notes")).alias("notes")),
    )


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove jobs by id from plan_jobs, state and jobs. ``ids`` holds distinct ids."""
    gone = ids.select("id")
    children = gone.withColumnRenamed("id", "job_id")
    return {
        "plan_jobs": tables["plan_jobs"].join(children, "job_id", "left_anti"),
        "state": tables["state"].join(children, "job_id", "left_anti"),
        "jobs": tables["jobs"].join(gone, "id", "left_anti"),
    }


def delete_label(tables: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """Remove a batch by label: its jobs with their children, then its batch row.

    A label without any job removes nothing, the batch row included.
    """
    ids = tables["jobs"].filter(F.col("import_date") == label).select("id", "import_date")
    result = cascade_delete(tables, ids)
    label_used = ids.select("import_date").limit(1)
    result["batches"] = tables["batches"].join(F.broadcast(label_used), "import_date", "left_anti")
    return result


def delete_imports(tables: dict[str, DataFrame], batch_ids: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """Remove import batches by id with their jobs. Active batches stay unless forced."""
    doomed = tables["batches"].join(batch_ids.select("id"), "id", "left_semi")
    if not force:
        doomed = doomed.filter(~F.col("status").isin(*ACTIVE))
    ids = tables["jobs"].join(doomed.select("import_date").distinct(), "import_date", "left_semi").select("id")
    result = cascade_delete(tables, ids)
    result["batches"] = tables["batches"].join(doomed.select("id"), "id", "left_anti")
    return result


def typed(text: Column, kind: T.DataType) -> Column:
    """Patch text as the column's type; maps, arrays and structs are JSON."""
    return F.from_json(text, kind) if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)) else text.cast(kind)


def patch(table: DataFrame, patches: DataFrame, order: Sequence[str], key: str = "id",
          allowed: Sequence[str] = IMPORT_PATCH_COLUMNS, at: Column | None = None) -> DataFrame:
    """Set allowed columns from patch rows (key, fields: map of column to text).

    A key in the map sets the column, to null as well; columns not allowed are ignored. ``updated_at``
    moves only where something allowed was set. Where an id has several patches, each column takes its last
    setting by ``order``.
    """
    settable = [name for name in allowed if name in table.columns and name != key]
    fields = F.map_filter(F.col("fields"), lambda name, _: name.isin(*settable))
    settings = patches.select(key, F.struct(*order).alias("_place"), F.explode(fields).alias("_name", "_value"))
    last = settings.groupBy(key, "_name").agg(F.max_by(F.struct("_value"), "_place").alias("_set"))
    # at most one entry per column of the table
    changes = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_set._value"))).alias("_fields"))
    joined = table.join(changes, key, "left")

    def pick(field) -> Column:
        name = field.name
        if name == "updated_at" and at is not None and name not in settable:
            return F.when(F.size("_fields") > 0, at).otherwise(F.col(name)).alias(name)
        if name not in settable:
            return F.col(name)
        return F.when(F.map_contains_key("_fields", name), typed(F.col("_fields")[name], field.dataType)).otherwise(
            F.col(name)).alias(name)
    return joined.select(*[pick(field) for field in table.schema.fields])


def update_applicants(state: DataFrame, updates: DataFrame, at: Column, order: Sequence[str]) -> DataFrame:
    """Set applicant texts by job id, the last by ``order``, and keep all other state fields; unknown jobs get a new row."""
    changes = _last(updates.filter(F.col("applicants").isNotNull()), "job_id", order)
    joined, stored, changed = _both(state, changes, "job_id")

    def pick(field) -> Column:
        name, old = field.name, F.col(f"_old.{field.name}")
        if name == "applicants":
            return F.when(changed, F.col("_new.applicants")).otherwise(old).alias(name)
        if name == "updated_at":
            return F.when(changed, at).otherwise(old).alias(name)
        if name == "status":
            return F.when(stored, old).otherwise(F.lit(NEW_STATUS)).alias(name)
        if name == "timestamps":
            return F.when(stored, old).otherwise(F.create_map().cast(field.dataType)).alias(name)
        return old.alias(name)
    return joined.select("job_id", *[pick(field) for field in state.schema.fields if field.name != "job_id"])


def update_counters(candidates: DataFrame) -> DataFrame:
    """Updated, failed and skipped applicant refreshes, from rescrape candidates with a fetched phrase."""
    got = F.col("phrase").isNotNull()
    return candidates.agg(
        F.count_if(F.col("candidate") & got).alias("updated"),
        F.count_if(F.col("candidate") & ~got).alias("failed"),
        F.count_if(~F.col("candidate")).alias("skipped"),
    )


def cleanup_report(jobs: DataFrame, rules: Rules) -> DataFrame:
    """Stored jobs that the current rules exclude, with the reason, by company."""
    reason = reject_reason(F.col("company"), F.col("description"), rules)
    return (
        jobs.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        .select("id", "company", "title", "reason").orderBy(F.lower("company"), "id")
    )


def cleanup(tables: dict[str, DataFrame], rules: Rules, apply: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The cleanup report and the tables after it; a dry run returns the tables unchanged."""
    report = cleanup_report(tables["jobs"], rules)
    return report, cascade_delete(tables, report.select("id")) if apply else dict(tables)


def merge_catalog(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows plus the new ones, marked by ``added``."""
    added = new_by_key(incoming, stored)
    return stored.withColumn("added", F.lit(False)).unionByName(
        added.withColumn("added", F.lit(True)), allowMissingColumns=True)


def migrate_jobs(jobs: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy jobs into the table: the merged table and counts of read, inserted and skipped rows.

    Rows without an id are passed over; of a repeated id the first (by ``pos``) is inserted.
    """
    usable = jobs.filter(or_empty(F.col("id")) != "")
    once = first_wins(usable, ["id"], ["pos"])
    flagged = once.select("id").join(stored.select("id").withColumn("_stored", F.lit(True)), "id", "left")
    inserted = flagged.agg(F.count_if(F.col("_stored").isNull()).alias("inserted"))
    read = usable.agg(F.count("*").alias("read"))
    counts = read.withColumn("inserted", inserted.scalar()).withColumn("skipped", F.col("read") - F.col("inserted"))
    return insert_absent(stored, once, ["pos"]), counts


def migrate_states(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """A state row per legacy job: its own state, or the defaults."""
    ids = jobs.filter(or_empty(F.col("id")) != "").select(F.col("id").alias("job_id")).distinct()
    return ids.join(states, "job_id", "left").withColumns({
        "status": F.coalesce("status", F.lit(NEW_STATUS)),
        "timestamps": F.coalesce("timestamps", F.create_map().cast("map<string,string>")),
    })


