"""Queries over state tables: saves, updates, deletes, defaults, lookups, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import case
from checks.views import Views, as_of, with_views
from noticelake.functions import text as tx
from noticelake.operators import quality, state, vectors
from noticelake.sources import tables

# ---- tables -----------------------------------------------------------------------------------------


@case("scan_tables", with_views("saved", """
    SELECT user_email, notice_id, status, round(contract_value, 2) AS contract_value, strftime(deadline, '%Y-%m-%d') AS deadline FROM saved"""))
def scan_tables(v: Views):
    """Saved notices stored with their relational schema and read back by it."""
    import uuid

    from noticelake.session import stage_dir

    root = f"{stage_dir(v.spark)}/tables-{uuid.uuid4().hex}"
    want = tables.schema("saved_contracts")
    have = v.saved.columns
    rows = v.saved.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])
    rows.write.parquet(f"{root}/saved_contracts")
    back = tables.scan_table(v.spark, root, "saved_contracts")
    return back.select(
        "user_email", "notice_id", "status", F.col("contract_value").cast("double").alias("contract_value"),
        F.date_format("deadline", "yyyy-MM-dd").alias("deadline"),
    )


# ---- saved notices ------------------------------------------------------------------------------------

# The log: every line item is an action of its order's customer on the order's notice. Line numbers
# are not unique within an order, so the sequence is a rank over all of the line's keys.
LOG_SQL = """log AS (
    SELECT o_custkey, l_orderkey, CASE l_returnflag WHEN 'N' THEN 'save' WHEN 'A' THEN 'status' ELSE CASE WHEN l_linestatus = 'F' THEN 'unsave' ELSE 'save' END END AS action,
           CASE WHEN l_returnflag = 'A' THEN CASE l_linenumber % 5 WHEN 0 THEN 'bidding' WHEN 1 THEN 'won' WHEN 2 THEN 'lost' WHEN 3 THEN 'archived' ELSE 'interested' END END AS status,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'note ' || l_partkey END AS notes,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def log(v: Views):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = F.col("l_linenumber") % 5
    action = F.when(F.col("l_returnflag") == "N", "save").when(F.col("l_returnflag") == "A", "status").when(
        F.col("l_linestatus") == "F", "unsave").otherwise("save")
    status = F.when(F.col("l_returnflag") == "A", F.when(n == 0, "bidding").when(n == 1, "won").when(n == 2, "lost").when(n == 3, "archived").otherwise("interested"))
    note = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), F.concat(F.lit("note "), F.col("l_partkey").cast("string")))
    orders = v.table("orders").select("o_orderkey", "o_custkey")
    return v.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_email"), F.col("l_orderkey").alias("notice_id"), action.alias("action"), status.alias("status"),
        note.alias("notes"), F.row_number().over(w).alias("seq"),
    )


@case("fold_saved", f"""WITH RECURSIVE {LOG_SQL},
    walk AS (
      SELECT o_custkey, l_orderkey, 0::BIGINT AS seq, false AS held, NULL::VARCHAR AS status, NULL::VARCHAR AS notes, NULL::BIGINT AS saved_seq FROM (SELECT DISTINCT o_custkey, l_orderkey FROM log)
      UNION ALL
      SELECT w.o_custkey, w.l_orderkey, l.seq,
             CASE l.action WHEN 'save' THEN true WHEN 'unsave' THEN false ELSE w.held END,
             CASE WHEN l.action = 'unsave' THEN NULL WHEN l.action = 'save' AND NOT w.held THEN 'interested'
                  WHEN l.action = 'status' AND w.held AND l.status IN ('interested','bidding','won','lost') THEN l.status ELSE w.status END,
             CASE WHEN l.action = 'unsave' THEN NULL WHEN l.action = 'status' AND w.held AND l.status IN ('interested','bidding','won','lost') THEN coalesce(l.notes, w.notes) ELSE w.notes END,
             CASE WHEN l.action = 'unsave' THEN NULL WHEN l.action = 'save' AND NOT w.held THEN l.seq ELSE w.saved_seq END
      FROM walk w JOIN log l ON l.l_orderkey = w.l_orderkey AND l.o_custkey = w.o_custkey AND l.seq = w.seq + 1),
    last AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq DESC) AS z FROM walk)
    SELECT o_custkey AS user_email, l_orderkey AS notice_id, status, notes, saved_seq::INT AS saved_seq FROM last WHERE z = 1 AND held""")
def fold_saved(v: Views):
    return state.fold_saved(log(v)).select("user_email", "notice_id", "status", "notes", "saved_seq")


@case("apply_saves", f"""WITH {LOG_SQL},
    state AS (SELECT o_custkey, l_orderkey, 'won' AS status FROM log WHERE action = 'unsave' GROUP BY 1, 2)
    SELECT o_custkey AS user_email, l_orderkey AS notice_id, status FROM state
    UNION ALL SELECT o_custkey, l_orderkey, 'interested' FROM log WHERE action = 'save' AND (o_custkey, l_orderkey) NOT IN (SELECT (o_custkey, l_orderkey) FROM state) GROUP BY 1, 2""")
def apply_saves(v: Views):
    events = log(v)
    held = events.where("action = 'unsave'").select("user_email", "notice_id").distinct().withColumn("status", F.lit("won"))
    saves = events.where("action = 'save'").select("user_email", "notice_id", "seq")
    return state.apply_saves(held, saves)


@case("apply_status", with_views("saved", f"""WITH {LOG_SQL},
    valid AS (SELECT 'N-' || l_orderkey AS notice_id, max_by(status, seq) AS status, max_by(notes, seq) FILTER (notes IS NOT NULL) AS notes
              FROM log WHERE action = 'status' AND status IN ('interested','bidding','won','lost') GROUP BY 1)
    SELECT s.notice_id, coalesce(v.status, s.status) AS status, v.notes FROM saved s LEFT JOIN valid v USING (notice_id)"""))
def apply_status(v: Views):
    people = v.users.select(F.col("user_id"), "email")
    changes = log(v).where("action = 'status'").join(people, F.col("user_email") == F.col("user_id")).select(
        F.col("email").alias("user_email"), F.concat(F.lit("N-"), F.col("notice_id").cast("string")).alias("notice_id"), "status", "notes", "seq"
    )
    return state.apply_status(v.saved, changes).select("notice_id", "status", "notes")


@case("apply_unsaves", with_views("saved", "SELECT user_email, notice_id FROM saved WHERE status <> 'lost'"))
def apply_unsaves(v: Views):
    gone = v.saved.where("status = 'lost'").select("user_email", "notice_id")
    return state.apply_unsaves(v.saved, gone).select("user_email", "notice_id")


@case("is_saved", with_views("users saved", """
    SELECT email AS user_email, 'N-' || user_id AS notice_id, s.status AS saved_status, s.status IS NOT NULL AS is_saved
    FROM users LEFT JOIN saved s ON s.user_email = email AND s.notice_id = 'N-' || user_id"""))
def is_saved(v: Views):
    asked = v.users.select(F.col("email").alias("user_email"), F.concat(F.lit("N-"), F.col("user_id").cast("string")).alias("notice_id"))
    return state.is_saved(asked, v.saved)


@case("saved_totals", with_views("saved", "SELECT user_email, status, count(*) AS total FROM saved GROUP BY 1, 2"))
def saved_totals(v: Views):
    return state.saved_totals(v.saved)


@case("saved_list", with_views("saved", "SELECT user_email, notice_id, strftime(saved_at, '%Y-%m-%d') AS saved_at FROM saved WHERE status = 'bidding'"))
def saved_list(v: Views):
    return state.saved_list(v.saved, "bidding").select("user_email", "notice_id", F.date_format("saved_at", "yyyy-MM-dd").alias("saved_at"))


# ---- updates ------------------------------------------------------------------------------------------

CHANGES_SQL = "changes AS (SELECT firm_id, CASE WHEN balance > 5000 THEN 'Renamed ' || company_id END AS company_name, CASE WHEN balance < 7000 THEN 'MARS' END AS region FROM firms WHERE balance > 3000)"


def firm_changes(v: Views):
    b = F.col("balance")
    return v.firms.where(b > 3000).select(
        "firm_id", F.when(b > 5000, F.concat(F.lit("Renamed "), F.col("company_id").cast("string"))).alias("company_name"), F.when(b < 7000, "MARS").alias("region")
    )


@case("patch_update", with_views("firms", f"""WITH {CHANGES_SQL}
    SELECT f.firm_id, coalesce(c.company_name, f.company_name) AS company_name, coalesce(c.region, f.region) AS region FROM firms f LEFT JOIN changes c USING (firm_id)"""))
def patch_update(v: Views):
    return state.patch_update(v.firms.select("firm_id", "company_name", "region"), firm_changes(v), "firm_id")


@case("replace_update", with_views("firms", f"""WITH {CHANGES_SQL}
    SELECT f.firm_id, CASE WHEN c.firm_id IS NULL THEN f.company_name ELSE c.company_name END AS company_name,
           CASE WHEN c.firm_id IS NULL THEN f.region ELSE c.region END AS region FROM firms f LEFT JOIN changes c USING (firm_id)"""))
def replace_update(v: Views):
    return state.replace_update(v.firms.select("firm_id", "company_name", "region"), firm_changes(v), "firm_id")


@case("fill_defaults", with_views("users firms preferences", """
    SELECT firm_id, company_name, NULL AS description, NULL AS size FROM firms
    UNION ALL SELECT DISTINCT firm_id, firm_id, '', 'SMALL' FROM users WHERE firm_id NOT IN (SELECT firm_id FROM firms)
    UNION ALL SELECT firm_id, 'preferences', NULL, CASE WHEN firm_id IN (SELECT firm_id FROM preferences) THEN 'own' ELSE 'default' END FROM firms"""))
def fill_defaults(v: Views):
    none = F.lit(None).cast("string")
    profiles = state.fill_default_profiles(v.users, v.firms.select("firm_id", "company_name", none.alias("description"), none.alias("size")))
    prefs = state.fill_default_preferences(v.firms, v.preferences)
    made = F.when((F.size("keywords") == 0) & F.col("min_contract_value").isNull(), "default").otherwise("own")
    return profiles.unionByName(prefs.select("firm_id", F.lit("preferences").alias("company_name"), none.alias("description"), made.alias("size")))


@case("cascade_delete", with_views("firms capabilities past_wins preferences convs messages requests_log", """
    WITH gone AS (SELECT firm_id FROM firms WHERE balance < 2000), lost AS (SELECT DISTINCT company_id AS user_id FROM firms WHERE balance < 2000)
    SELECT 'capabilities' AS name, count(*) AS n FROM capabilities WHERE firm_id NOT IN (SELECT firm_id FROM gone)
    UNION ALL SELECT 'past_wins', count(*) FROM past_wins WHERE firm_id NOT IN (SELECT firm_id FROM gone)
    UNION ALL SELECT 'preferences', count(*) FROM preferences WHERE firm_id NOT IN (SELECT firm_id FROM gone)
    UNION ALL SELECT 'conversations', count(*) FROM convs WHERE user_id NOT IN (SELECT user_id FROM lost)
    UNION ALL SELECT 'messages', count(*) FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM convs WHERE user_id IN (SELECT user_id FROM lost))
    UNION ALL SELECT 'audit with user', count(*) FROM requests_log WHERE user_id::BIGINT NOT IN (SELECT user_id FROM lost)"""))
def cascade_delete(v: Views):
    gone = v.firms.where("balance < 2000").select("firm_id")
    kept = state.cascade_delete_firm(gone, {
        "capabilities": v.capability_rows, "past_wins": v.past_wins, "preferences": v.preferences,
    })
    users = v.firms.where("balance < 2000").select(F.col("company_id").alias("user_id"))
    audit = v.requests_log.withColumn("user_id", F.col("user_id").cast("long"))
    conv, msg, log_rows = state.cascade_delete_user(users, v.conversations, v.messages, audit)
    kept |= {"conversations": conv, "messages": msg, "audit with user": log_rows.where("user_id IS NOT NULL")}
    out = None
    for name, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


ONBOARD_SQL = "people AS (SELECT c_custkey AS user_id, c_nationkey % 3 AS onboarding_completed, c_nationkey % 5 AS onboarding_step, c_acctbal FROM customer)"


@case("onboarding_update", f"""WITH {ONBOARD_SQL}
    SELECT user_id, CASE WHEN c_acctbal > 8000 THEN 2 WHEN c_acctbal < 0 THEN 0 WHEN onboarding_completed = 0 THEN 2 ELSE onboarding_completed END::INT AS onboarding_completed,
           CASE WHEN c_acctbal > 8000 THEN 4 WHEN c_acctbal < 0 THEN 0 WHEN onboarding_completed = 0 THEN 4 ELSE onboarding_step END::INT AS onboarding_step,
           CASE WHEN c_acctbal > 8000 THEN '1998-01-01' WHEN c_acctbal < 0 THEN NULL WHEN onboarding_completed = 0 THEN '1997-01-01' END AS completed_at FROM people""")
def onboarding_update(v: Views):
    """Backfill all, then complete some and reset others."""
    people = onboard(v)
    people = state.onboarding_update(people, "backfill")
    people = state.onboarding_update(people, "complete", F.col("c_acctbal") > 8000, as_of())
    people = state.onboarding_update(people, "reset", F.col("c_acctbal") < 0)
    return people.select("user_id", "onboarding_completed", "onboarding_step", F.date_format("onboarding_completed_at", "yyyy-MM-dd").alias("completed_at"))


def onboard(v: Views):
    return v.table("customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 3).cast("int").alias("onboarding_completed"),
        (F.col("c_nationkey") % 5).cast("int").alias("onboarding_step"), F.lit(None).cast("timestamp").alias("onboarding_completed_at"),
        F.lit("1997-01-01").cast("timestamp").alias("created_at"), "c_acctbal",
    )


@case("onboarding_state", f"WITH {ONBOARD_SQL} SELECT user_id, onboarding_completed < 2 AS needs_onboarding FROM people")
def onboarding_state(v: Views):
    return state.onboarding_state(onboard(v)).select("user_id", "needs_onboarding")


@case("refresh_vectors", with_views("capabilities nv", """
    WITH caps AS (SELECT *, CASE WHEN vec_id IS NOT NULL THEN 'v-' || capability_id END AS vector_id FROM capabilities),
    changed AS (SELECT capability_id FROM caps WHERE category = 'Brand#3')
    SELECT capability_id, CASE WHEN c.category = 'Brand#3' THEN 'new ' || capability_text ELSE capability_text END AS capability_text, category,
           CASE WHEN c.category = 'Brand#3' THEN 'w-' || capability_id ELSE vector_id END AS vector_id,
           c.category = 'Brand#3' OR vector_id IS NOT NULL AS stored FROM caps c"""))
def refresh_vectors(v: Views):
    ident = F.col("capability_id").cast("string")
    caps = v.capabilities.withColumn("vector_id", F.when(F.col("vec_id").isNotNull(), F.concat(F.lit("v-"), ident)))
    store = caps.where("vector_id IS NOT NULL").select("vector_id", "embedding")
    rows = caps.select("capability_id", "capability_text", "category", "vector_id")
    changes = rows.where("category = 'Brand#3'").select(
        "capability_id", F.concat(F.lit("new "), "capability_text").alias("capability_text"), F.lit(None).cast("string").alias("category")
    )
    made = vectors.embed_hash(changes, "capability_id", "capability_text").withColumn("vector_id", F.concat(F.lit("w-"), ident))
    new_rows, new_store = state.refresh_vectors(rows, store, changes, made)
    held = new_store.select("vector_id", F.lit(True).alias("stored"))
    return new_rows.join(held, "vector_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


@case("insert_if_absent", """
    SELECT 'taken' AS part, key, count(*) AS n FROM (
      SELECT c_nationkey::VARCHAR AS key, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)
    WHERE key NOT IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 0) GROUP BY 2
    UNION ALL SELECT 'stored', n_nationkey::VARCHAR, 1 FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT 'rejected', c_nationkey::VARCHAR, count(*) - CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) THEN 0 ELSE 1 END FROM customer
    GROUP BY c_nationkey HAVING count(*) - CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) THEN 0 ELSE 1 END > 0""")
def insert_if_absent(v: Views):
    stored = v.table("nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("string").alias("key"), F.lit("stored").alias("part"))
    new = v.table("customer").select(F.col("c_nationkey").cast("string").alias("key"), F.lit("taken").alias("part"), "c_custkey")
    kept, rejected = state.insert_if_absent(stored, new, "key", "c_custkey")
    both = kept.select("part", "key").unionByName(rejected.select(F.lit("rejected").alias("part"), "key"))
    return both.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))


# ---- lookups ------------------------------------------------------------------------------------------


@case("owned_lookup", with_views("capabilities", """
    SELECT c.capability_id, c.firm_id FROM capabilities c JOIN part p ON p.p_partkey = c.capability_id
    WHERE c.firm_id = 'firm-supplier#' || lpad((p.p_size)::VARCHAR, 9, '0')"""))
def owned_lookup(v: Views):
    asked = v.table("part").select(F.col("p_partkey").alias("capability_id"), v.slug("p_size").alias("firm_id"))
    return state.owned_lookup(v.capability_rows, asked, "capability_id").select("capability_id", "firm_id")


@case("notice_lookup", with_views("points", """
    SELECT notice_id, m_title AS title, value FROM points WHERE notice_id IN (SELECT 'N-' || user_id FROM events)"""))
def notice_lookup(v: Views):
    asked = v.table("events").select(F.concat(F.lit("N-"), F.col("user_id").cast("string")).alias("notice_id"))
    return state.notice_lookup(v.points.drop("embedding"), asked).select("notice_id", F.col("metadata.title").alias("title"), "value")


@case("profile_assemble", with_views("firms capabilities past_wins preferences", """
    SELECT f.firm_id, (SELECT string_agg(capability_id::VARCHAR, ',' ORDER BY capability_id) FROM capabilities c WHERE c.firm_id = f.firm_id) AS capabilities,
           (SELECT string_agg(win_id, ',' ORDER BY win_id) FROM past_wins w WHERE w.firm_id = f.firm_id) AS past_wins,
           p.firm_id IS NOT NULL AS has_preferences FROM firms f LEFT JOIN preferences p USING (firm_id)"""))
def profile_assemble(v: Views):
    p = state.profile_assemble(v.firms, v.capability_rows, v.past_wins, v.preferences)
    ids = lambda c, f: F.nullif(F.array_join(F.transform(c, lambda e: e[f].cast("string")), ","), F.lit(""))
    return p.select(
        "firm_id", ids("capabilities", "capability_id").alias("capabilities"), ids("past_wins", "win_id").alias("past_wins"),
        F.col("search_preference").isNotNull().alias("has_preferences"),
    )


@case("past_wins_recent", with_views("past_wins", """SELECT firm_id, win_id, strftime(award_date, '%Y-%m-%d') AS award_date,
    (row_number() OVER (PARTITION BY firm_id ORDER BY award_date DESC, win_id))::INT AS place FROM past_wins"""))
def past_wins_recent(v: Views):
    """The listing, with the place its order gives each win."""
    from pyspark.sql import Window

    listed = state.past_wins_recent(v.past_wins).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("firm_id").orderBy("at")).alias("place")
    return listed.select("firm_id", "win_id", F.date_format("award_date", "yyyy-MM-dd").alias("award_date"), place)


@case("distinct_documents", """
    SELECT conv_id AS document_id, min(turn)::INT AS chunk_index, min_by(role, turn) AS role, count(*) > 0 AS held FROM conversations GROUP BY 1""")
def distinct_documents(v: Views):
    chunks = v.table("conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), "role", F.lit(True).alias("held")
    )
    return state.distinct_documents(chunks)


@case("firm_slug", "SELECT s_suppkey, 'firm-' || translate(lower(s_name || ' ' || 'A_B'), ' _', '--') AS slug FROM supplier")
def firm_slug(v: Views):
    return v.table("supplier").select("s_suppkey", tx.firm_slug(F.concat("s_name", F.lit(" "), F.lit("A_B"))).alias("slug"))


# ---- rules --------------------------------------------------------------------------------------------


@case("validate_rows", """
    SELECT rule, sum(n)::BIGINT AS rejected FROM (
      SELECT 'query length' AS rule, count(*) FILTER (length(left(p_name, p_size % 6)) < 3) AS n FROM part
      UNION ALL SELECT 'limit range', count(*) FILTER (p_size - 3 NOT BETWEEN 1 AND 50) FROM part
      UNION ALL SELECT 'minimum value', count(*) FILTER (p_retailprice - 950 < 0) FROM part
      UNION ALL SELECT 'maximum value', count(*) FILTER (p_size >= 25 AND p_retailprice - 1000 < 0) FROM part) WHERE n > 0 GROUP BY 1""")
def validate_rows(v: Views):
    rows = v.table("part").select(
        F.expr("left(p_name, p_size % 6)").alias("query"), (F.col("p_size") - 3).alias("limit"),
        (F.col("p_retailprice") - 950).alias("min_value"), F.when(F.col("p_size") >= 25, F.col("p_retailprice") - 1000).alias("max_value"),
    )
    return quality.rule_counts(rows, "search")


@case("validate_profiles", """
    SELECT c_custkey, concat_ws('|', CASE WHEN c_nationkey = 3 THEN 'name length' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'FURNITURE') THEN 'size' END,
           CASE WHEN 1790 + c_nationkey * 10 NOT BETWEEN 1800 AND 2025 THEN 'founded year' END) AS broken
    FROM customer WHERE c_nationkey = 3 OR c_mktsegment NOT IN ('BUILDING', 'FURNITURE') OR 1790 + c_nationkey * 10 NOT BETWEEN 1800 AND 2025""")
def validate_profiles(v: Views):
    rows = v.table("customer").select(
        "c_custkey", F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("company_name"), F.lit(None).cast("string").alias("registration_number"),
        F.when(F.col("c_mktsegment") == "BUILDING", "small").when(F.col("c_mktsegment") == "FURNITURE", "large").otherwise("huge").alias("size"),
        (F.col("c_nationkey") * 10 + 1790).alias("founded_year"),
    )
    return quality.rejects(rows, "profile").select("c_custkey", F.array_join("broken_rules", "|").alias("broken"))
