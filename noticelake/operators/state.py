"""State tables: change logs folded into saved notices, updates, deletes and defaults.

Each operator reduces the change side first (an aggregation per key) and meets the stored side in
one equi-join, so stored tables are shuffled once at most and never windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticelake.operators.ingest import delete_keys, first_by, upsert
from noticelake.operators.lists import paged_lists

# Life of a saved notice.
FIRST_STATUS = "interested"
STATUSES = ("interested", "bidding", "won", "lost")
SAVED_KEY = ["user_email", "notice_id"]


def apply_saves(state: DataFrame, saves: DataFrame, order: str = "seq") -> DataFrame:
    """The first save of a (user, notice) creates its row; later saves of a stored pair change nothing."""
    fresh = delete_keys(saves, state, SAVED_KEY)
    first = first_by(fresh, SAVED_KEY, order).withColumn("status", F.lit(FIRST_STATUS)).drop(order)
    return state.unionByName(first, allowMissingColumns=True)


def apply_status(state: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Latest valid status per key; the latest given notes stay when a change brings none."""
    valid = changes.where(F.col("status").isin(*STATUSES))
    latest = valid.groupBy(*SAVED_KEY).agg(
        F.max_by("status", order).alias("_status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col(order))).alias("_notes"),
    )
    return (
        state.join(latest, SAVED_KEY, "left")
        .withColumns({"status": F.coalesce("_status", "status"), "notes": F.coalesce("_notes", "notes")})
        .drop("_status", "_notes")
    )


def apply_unsaves(state: DataFrame, unsaves: DataFrame) -> DataFrame:
    return delete_keys(state, unsaves, SAVED_KEY)


def fold_saved(log: DataFrame, order: str = "seq") -> DataFrame:
    """A whole log of ``save`` / ``status`` / ``unsave`` actions folded in event order per key.

    What happened up to a key's last unsave is void; of the rest, the first save makes the row and
    later valid status changes move it. All of it is two aggregations on the key.
    """
    gone = F.max(F.when(F.col("action") == "unsave", F.col(order)))
    cut = log.groupBy(*SAVED_KEY).agg(gone.alias("_gone"))
    live = log.join(cut, SAVED_KEY).where(F.col("_gone").isNull() | (F.col(order) > F.col("_gone")))
    saved_at = live.where("action = 'save'").groupBy(*SAVED_KEY).agg(F.min(order).alias("saved_seq"))
    moves = (F.col("action") == "status") & F.col("status").isin(*STATUSES) & (F.col(order) > F.col("saved_seq"))
    merged = live.join(saved_at, SAVED_KEY).groupBy(*SAVED_KEY).agg(
        F.first("saved_seq").alias("saved_seq"),
        F.max_by("status", F.when(moves, F.col(order))).alias("status"),
        F.max_by("notes", F.when(moves & F.col("notes").isNotNull(), F.col(order))).alias("notes"),
    )
    return merged.withColumn("status", F.coalesce("status", F.lit(FIRST_STATUS)))


def _changed(state: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    return state.join(renamed, key, "left"), fields


def patch_update(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only given (non-null) fields overwrite. ``changes`` has one row per key."""
    joined, fields = _changed(state, changes, key)
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields}).select(*state.columns)


def replace_update(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """All fields overwrite, nulls included."""
    joined, fields = _changed(state, changes, key)
    put = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(put).select(*state.columns)


def fill_default_profiles(firm_ids: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles plus a default row for every firm id that has none."""
    missing = firm_ids.select("firm_id").distinct().join(profiles.select("firm_id"), "firm_id", "left_anti")
    made = missing.select(
        "firm_id", F.col("firm_id").alias("company_name"), F.lit("").alias("description"), F.lit("SMALL").alias("size")
    )
    return profiles.unionByName(made, allowMissingColumns=True)


def fill_default_preferences(firms: DataFrame, preferences: DataFrame) -> DataFrame:
    missing = firms.select("firm_id").join(preferences.select("firm_id"), "firm_id", "left_anti")
    empty = F.array().cast("array<string>")
    made = missing.withColumns({c: empty for c in ("preferred_regions", "excluded_categories", "keywords")})
    return preferences.unionByName(made, allowMissingColumns=True)


def cascade_delete_firm(gone: DataFrame, children: dict[str, DataFrame], key: str = "firm_id") -> dict[str, DataFrame]:
    """Child tables without the rows of deleted firms."""
    return {name: delete_keys(df, gone, [key]) for name, df in children.items()}


def cascade_delete_user(
    gone: DataFrame, conversations: DataFrame, messages: DataFrame, audit: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations of deleted users and their messages go; audit rows stay without the user."""
    lost = conversations.join(gone.select("user_id"), "user_id", "left_semi")
    kept_messages = messages.join(lost.select("conversation_id"), "conversation_id", "left_anti")
    marked = gone.select("user_id", F.lit(True).alias("_gone"))
    cleared = audit.join(marked, "user_id", "left").withColumn(
        "user_id", F.when(F.col("_gone"), None).otherwise(F.col("user_id"))
    ).drop("_gone")
    return delete_keys(conversations, gone, ["user_id"]), kept_messages, cleared


# Onboarding states (completed flag, step).
ONBOARDING_DONE, ONBOARDING_START = (2, 4), (0, 0)


def onboarding_state(users: DataFrame) -> DataFrame:
    return users.withColumn("needs_onboarding", F.col("onboarding_completed") < ONBOARDING_DONE[0])


def onboarding_update(users: DataFrame, action: str, who: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """``complete`` and ``reset`` the chosen rows, or ``backfill`` all rows still at the start."""
    who = F.lit(True) if who is None else who
    if action == "backfill":
        who = F.col("onboarding_completed") == ONBOARDING_START[0]
    done, step = ONBOARDING_START if action == "reset" else ONBOARDING_DONE
    at = {"complete": as_of, "backfill": F.col("created_at"), "reset": F.lit(None).cast("timestamp")}[action]
    put = {"onboarding_completed": F.lit(done), "onboarding_step": F.lit(step), "onboarding_completed_at": at}
    return users.withColumns({c: F.when(who, v).otherwise(F.col(c)) for c, v in put.items()})


def refresh_vectors(
    capabilities: DataFrame, store: DataFrame, changes: DataFrame, vectors: DataFrame, key: str = "capability_id"
) -> tuple[DataFrame, DataFrame]:
    """Changed capability texts: the old vector leaves the store and the new one (``vectors`` by key,
    with its ``vector_id``) takes its place; the category stays when none is given."""
    touched = capabilities.join(changes.select(key), key, "left_semi")
    rows = patch_update(capabilities, changes, key)
    rows = patch_update(rows, vectors.select(key, "vector_id"), key)
    pruned = delete_keys(store, touched.where("vector_id is not null"), ["vector_id"])
    fresh = vectors.select("vector_id", "embedding", F.lit(1).alias("_seq"))
    return rows, upsert(pruned, fresh, "vector_id", "_seq")


def touch_parent(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """``updated_at`` moved to the latest message."""
    last = messages.groupBy("conversation_id").agg(F.max("timestamp").alias("_last"))
    joined = conversations.join(last, "conversation_id", "left")
    return joined.withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def insert_if_absent(state: DataFrame, new: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """New keys are added, the first row per key; returns ``(state, rejected)`` with the rows turned away.

    Of rows tied on ``order`` one is taken, by the hash of its other columns.
    """
    others = [c for c in new.columns if c not in (key, order)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, F.xxhash64(*others) if others else F.lit(0)))
    known = state.select(key, F.lit(True).alias("_known"))
    judged = new.withColumn("_place", place).join(known, key, "left")
    taken = F.col("_known").isNull() & (F.col("_place") == 1)
    accepted = judged.where(taken).drop("_place", "_known", order)
    rejected = judged.where(~taken).drop("_place", "_known")
    return state.unionByName(accepted, allowMissingColumns=True), rejected


def is_saved(pairs: DataFrame, state: DataFrame) -> DataFrame:
    held = state.select(*SAVED_KEY, F.col("status").alias("saved_status"))
    return pairs.join(held, SAVED_KEY, "left").withColumn("is_saved", F.col("saved_status").isNotNull())


def saved_totals(state: DataFrame) -> DataFrame:
    """Saved notices per user and status."""
    return state.groupBy("user_email", "status").agg(F.count(F.lit(1)).alias("total"))


def saved_list(state: DataFrame, status: str | None = None) -> DataFrame:
    rows = state.where(F.col("status") == status) if status else state
    return rows.orderBy("user_email", F.desc("saved_at"), "notice_id")


def owned_lookup(rows: DataFrame, asked: DataFrame, key: str, owner: str = "firm_id") -> DataFrame:
    """Asked rows, but only those of the asking owner."""
    return rows.join(asked.select(key, owner), [key, owner], "left_semi")


def notice_lookup(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Details of the asked notices, one row per notice id (the lowest point id)."""
    found = points.join(asked.select("notice_id").distinct(), "notice_id", "left_semi")
    # A window leaves out columns that no one reads; an aggregation of whole rows would take their texts along.
    lowest = F.row_number().over(Window.partitionBy("notice_id").orderBy(F.asc_nulls_last("point_id")))
    return found.withColumn("_n", lowest).where(F.col("_n") == 1).select(*points.columns)


def profile_assemble(firms: DataFrame, capabilities: DataFrame, past_wins: DataFrame, preferences: DataFrame) -> DataFrame:
    """One nested row per firm; a firm with more records than a page holds gets further rows, numbered
    by ``page``. Scoring never uses these lists."""
    caps = paged_lists(capabilities, ["firm_id"], ["capability_id", "capability_text", "category"], "capabilities")
    wins = paged_lists(past_wins, ["firm_id"], ["win_id", "buyer_name", "contract_value", "award_date"], "past_wins")
    prefs = preferences.select("firm_id", F.struct(*[c for c in preferences.columns if c != "firm_id"]).alias("search_preference"))
    # Page 0 of every firm exists even if it has no records at all.
    first = firms.select("firm_id", F.lit(0).alias("page"))
    pages = first.union(caps.select("firm_id", "page")).union(wins.select("firm_id", "page")).distinct()
    key = ["firm_id", "page"]
    joined = firms.join(pages, "firm_id").join(caps, key, "left").join(wins, key, "left").join(prefs, "firm_id", "left")
    none = lambda name: F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType))
    return joined.withColumns({"capabilities": none("capabilities"), "past_wins": none("past_wins")})


def past_wins_recent(past_wins: DataFrame) -> DataFrame:
    return past_wins.orderBy("firm_id", F.desc("award_date"), "win_id")


def distinct_documents(chunks: DataFrame) -> DataFrame:
    """One row per document with the attributes of its first chunk."""
    return first_by(chunks, ["document_id"], "chunk_index")


def scroll_points(points: DataFrame, limit: int, conditions: Column | None = None) -> DataFrame:
    """Up to ``limit`` points in id order (Spark keeps the best rows per task, not a global sort)."""
    rows = points if conditions is None else points.where(conditions)
    return rows.orderBy("point_id").limit(limit)
