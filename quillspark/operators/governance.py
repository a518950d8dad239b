"""Access, listing, life cycle and ingest state, as joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import constants as C
from quillspark.functions.text import payload_hash
from quillspark.scratch import Scratch


def parts(rows: DataFrame, most: int = 500_000) -> int:
    """Into how many parts ``rows`` are dealt so that a task's share doesn't grow with them; parts that
    Spark merges by their compressed size hold more rows the better these compress."""
    return max(-(-rows.count() // most), rows.sparkSession.sparkContext.defaultParallelism)


def live(status: Column) -> Column:
    """Neither hidden nor without a status."""
    return F.coalesce(~status.isin(*C.HIDDEN_STATUSES), F.lit(False))


def containing(text: str, *columns: str) -> Column:
    """Any of the columns contains the text whatever its case; % and _ in it are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return found


def only(rows: DataFrame, **values: object) -> DataFrame:
    """Equality filters; those whose value is None or "" are not applied."""
    for name, value in values.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order, each with the total."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def within_dates(iso: Column, date_from: str | None, date_to: str | None) -> Column:
    """Text comparison of ISO times: not before the first, not after 23:59:59 of the last."""
    good = F.lit(True)
    if date_from:
        good = good & ~(iso < date_from)
    if date_to:
        good = good & ~(iso > date_to + "T23:59:59")
    return good


def doc_kind(c: Column) -> Column:
    return F.when(c.isin(*C.DOC_KINDS), c).otherwise("other")


def canonical_status(c: Column) -> Column:
    out = c
    for old, new in C.STATUS_ALIASES.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def accessible(users: DataFrame, kbs: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, kb): all active ones for admins, those with a permission for the others."""
    active = kbs.where("is_active").select("kb")
    every = users.where("role = 'admin'").select("user_id").join(active, F.lit(True))  # admins see every one
    granted = permissions.join(users.where("role <> 'admin'").select("user_id"), "user_id").join(active, "kb")
    return every.union(granted.select("user_id", "kb")).distinct()


def decision(requests: DataFrame, permissions: DataFrame, kbs: DataFrame, users: DataFrame) -> DataFrame:
    """Adds decision to requests (user_id, kb, needs): 404 for no such active base, then 403, else 200.

    needs: viewer, editor, owner or admin, each of which includes those before it."""
    rank = lambda c: F.when(c == "viewer", 1).when(c == "editor", 2).when(c == "owner", 3).when(c == "admin", 4).otherwise(0)
    granted = permissions.select("user_id", "kb", rank(F.col("role")).alias("granted"))
    rows = requests.join(kbs.where("is_active").select("kb", F.lit(True).alias("found")), "kb", "left")
    rows = rows.join(granted, ["user_id", "kb"], "left").join(users.select("user_id", (F.col("role") == "admin").alias("admin")), "user_id", "left")
    held = F.when(F.col("admin"), 4).otherwise(F.coalesce("granted", F.lit(0)))
    code = F.when(F.col("found").isNull(), 404).when(held < rank(F.col("needs")), 403).otherwise(200)
    return rows.select(*requests.columns, code.alias("decision"))


def reconcile(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(kb, user_id, old_role, new_role, action) of permissions to be made equal to ``incoming``."""
    a, b = existing.withColumnRenamed("role", "old_role"), incoming.withColumnRenamed("role", "new_role")
    action = F.when(F.col("old_role").isNull(), "insert").when(F.col("new_role").isNull(), "delete").when(F.col("old_role") != F.col("new_role"), "update").otherwise("keep")
    return a.join(b, ["kb", "user_id"], "full_outer").withColumn("action", action)


def permission_faults(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """(kb, fault) of lists that can't be taken: duplicate_user, unknown_user or no_owner, the first that holds."""
    known = users.select("user_id", F.lit(1).alias("known"))
    rows = incoming.join(known, "user_id", "left").groupBy("kb").agg(
        (F.count("user_id") > F.count_distinct("user_id")).alias("twice"), F.bool_or(F.col("known").isNull()).alias("unknown"), F.bool_or(F.col("role") == "owner").alias("owned")
    )
    fault = F.when(F.col("twice"), "duplicate_user").when(F.col("unknown"), "unknown_user").when(~F.col("owned"), "no_owner")
    return rows.select("kb", fault.alias("fault")).where("fault is not null")


def new_names(existing: DataFrame, incoming: DataFrame, key: Column) -> DataFrame:
    """Rows of ``incoming`` (kb, name, pos) whose key is neither there already nor earlier in the batch."""
    there = existing.select("kb", key.alias("__key")).distinct()
    rows = incoming.withColumn("__key", key).join(there, ["kb", "__key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("kb", "__key").orderBy("pos"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n", "__key")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``current`` with the latest change of each key in its place."""
    latest = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return current.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*current.columns))


def request_deletion(documents: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents marked deleting, and their jobs asked to stop unless they have ended."""
    gone = ids.select("document_id", F.lit(True).alias("__gone")).distinct()
    marked = F.when(F.col("__gone"), F.lit("deleting")).otherwise(F.col("status"))
    stopped = F.when(F.col("__gone") & ~F.col("status").isin(*C.TERMINAL_JOB), "cancel_requested").otherwise(F.col("status"))
    set_ = lambda t, c: t.join(gone, "document_id", "left").withColumn("status", c).select(*t.columns)
    return set_(documents, marked), set_(jobs, stopped)


def artifact_paths(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-empty paths of several tables."""
    out = None
    for table, column in tables:
        part = table.select(F.col(column).alias("path")).where("path is not null and path <> ''")
        out = part if out is None else out.union(part)
    return out.distinct()


def audit_rows(rows: DataFrame, action: str, target_type: str, details: Column) -> DataFrame:
    """Audit rows to append, of ``rows`` (actor, target_id, forwarded, peer, agent): the first
    address, 512 characters of the agent, the details as JSON."""
    return rows.select(
        "actor", F.lit(action).alias("action"), F.lit(target_type).alias("target_type"), F.col("target_id").cast("string").alias("target_id"),
        client_ip(F.col("forwarded"), F.coalesce("peer", F.lit("unknown"))).alias("ip_address"), F.left(F.coalesce("agent", F.lit("")), F.lit(512)).alias("user_agent"), F.to_json(details).alias("details"),
    )


def dead_letters(
    documents: DataFrame, jobs: DataFrame, errors: DataFrame, most: int = 4000, note: int = 1000, text: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (document_id, uploader, status) and jobs with those that ``errors`` (job_id, error)
    names failed and dead, and an audit row for each; an error is cut, and comes once a job.

    ``text``: the error's text of the columns of ``errors``, where these are shorter than it. It is made
    after the joins, so no shuffle carries it. Errors are joined by sorting: a short estimate of long
    texts would have them sent whole through the driver."""
    text = F.col("error") if text is None else text
    n = parts(jobs)
    jobs, errors = jobs.repartition(n, "job_id"), errors.repartition(n, "job_id").hint("merge")
    bad = jobs.join(errors, "job_id")
    gone = bad.select("document_id", F.lit("failed").alias("__new")).distinct()
    marked = documents.join(gone, "document_id", "left").withColumn("status", F.coalesce("__new", "status")).select(*documents.columns)
    rows = jobs.join(errors.withColumn("__failed", F.lit(True)), "job_id", "left")
    failed = F.col("__failed") & text.isNotNull()
    updated = rows.withColumn("last_error", F.when(failed, F.left(text, F.lit(most))).otherwise(F.col("last_error"))).withColumn("status", F.when(failed, "dead").otherwise(F.col("status")))
    uploaders = documents.select("document_id", F.col("uploader").alias("actor")).repartition(n, "document_id")
    noted = bad.repartition(n, "document_id").join(uploaders, "document_id", "left")
    noted = noted.withColumns({"target_id": F.col("document_id"), "forwarded": F.lit(""), "peer": F.lit("worker"), "agent": F.lit("celery")})
    audit = audit_rows(noted, "ingest.step_failed", "document", F.struct("job_id", F.left(text, F.lit(note)).alias("error")))
    return marked, updated.select(*jobs.columns), audit


def retry(documents: DataFrame, jobs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents pending again, and a queued job more for each of ``asked`` (document_id, job_id, created_at)."""
    again = asked.select("document_id", F.lit("pending").alias("__new")).distinct()
    marked = documents.join(again, "document_id", "left").withColumn("status", F.coalesce("__new", "status")).select(*documents.columns)
    queued = asked.withColumn("status", F.lit("queued"))
    return marked, jobs.unionByName(queued.select(*jobs.columns))


def batch_deletions(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, decision, deleted) of ``asked`` (request_id, kb, role, document_id): 403 unless an
    owner or admin asks, 404 unless all documents are in the base, else 200 with their number.

    Both are dealt by document, where repeats are dropped and what is there is joined, then by request;
    no value that is folded is a string, which would have the rows sorted."""
    n = parts(asked)
    there = documents.select("document_id", "kb", F.lit(1).alias("__there")).repartition(n, "document_id", "kb").distinct()
    may = F.coalesce(F.col("role").isin("owner", "admin"), F.lit(False)).alias("may")
    each = asked.select("request_id", "document_id", "kb", may).repartition(n, "document_id", "kb").distinct().join(there, ["document_id", "kb"], "left")
    whole = each.repartition(n, "request_id").groupBy("request_id").agg(F.bool_and("may").alias("may"), F.count("document_id").alias("n"), F.count("__there").alias("found"))
    code = F.when(~F.col("may"), 403).when(F.col("found") < F.col("n"), 404).otherwise(200)
    return whole.select("request_id", code.alias("decision"), F.when(code == 200, F.col("n")).otherwise(0).alias("deleted"))


def bases(kbs: DataFrame, is_active: bool | None = None, text: str = "") -> DataFrame:
    """Bases for administrators: active ones unless the other state is asked for."""
    return kbs.where((F.col("is_active") == F.lit(True if is_active is None else is_active)) & containing(text, "name"))


def page_of_each(rows: DataFrame, by: list[str], order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` of each group's rows in a total order, each with its place and the group's total."""
    one = Window.partitionBy(*by)
    numbered = rows.withColumn("place", F.row_number().over(one.orderBy(*order))).withColumn("total", F.count("*").over(one))
    return numbered.where((F.col("place") > (number - 1) * size) & (F.col("place") <= number * size))


def queue(requests: DataFrame, size: int = 16) -> DataFrame:
    """``requests`` (request_id, priority, at) with status and place: the first ``size`` to come wait,
    by priority, time and id; the others are refused with 429."""
    first = requests.orderBy("at", "request_id").limit(size)
    waiting = first.withColumn("place", F.row_number().over(Window.orderBy("priority", "at", "request_id"))).select("request_id", "place")  # ``size`` rows
    return requests.join(F.broadcast(waiting), "request_id", "left").withColumn("status", F.when(F.col("place").isNull(), 429).otherwise(202))


def arity_faults(files: DataFrame, requests: DataFrame, most: int = 50) -> DataFrame:
    """(request_id, fault) of ``requests`` by the number of their ``files``: none, too_many, or null."""
    n = files.groupBy("request_id").agg(F.count("*").alias("n"))
    rows = requests.select("request_id").join(n, "request_id", "left")
    return rows.select("request_id", F.when(F.col("n").isNull(), "none").when(F.col("n") > most, "too_many").alias("fault"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def _lookup(c: Column, pairs: list[tuple[str, object]]) -> Column:
    out = F.lit(None)
    for name, value in pairs:
        out = F.when(c == name, F.lit(value)).otherwise(out)
    return out


def progress(documents: DataFrame, jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(document_id, phase, percent) from the status, the latest job and its finished steps.

    ``documents`` (document_id, status), ``jobs`` (job_id, document_id, status, created_at),
    ``receipts`` (job_id, step, status).
    """
    current = latest(jobs, "document_id", [F.desc("created_at"), F.desc("job_id")]).select("document_id", "job_id", F.col("status").alias("job_status"))
    order = F.array_position(F.array(*(F.lit(s) for s, _, _ in C.INGEST_STEPS)), F.col("step"))
    done = receipts.where("status = 'succeeded'").withColumn("n", order).where("n > 0").groupBy("job_id").agg(
        F.max("n").alias("last"), F.max(_lookup(F.col("step"), [(s, p) for s, p, _ in C.INGEST_STEPS])).alias("reached")
    )
    rows = documents.join(current, "document_id", "left").join(done, "job_id", "left")
    rank = lambda c: F.array_position(F.array(*(F.lit(p) for p in C.PHASES)), c)
    status = canonical_status(F.col("status"))
    base = F.when(rank(status) > 0, status).otherwise("pending")
    step_phase = _lookup(F.col("last"), [(i + 1, f) for i, (_, _, f) in enumerate(C.INGEST_STEPS)])
    phase = (
        F.when(status.isin(*C.TERMINAL_DOCUMENT), status)
        .when((F.col("job_status") == "succeeded") | (F.col("last") == len(C.INGEST_STEPS)), "ready")
        .when(F.col("job_status").isin("dead", "failed"), "failed")
        .when(F.coalesce(rank(step_phase) > rank(base), F.lit(False)), step_phase)
        .otherwise(base)
    )
    floor = F.coalesce(_lookup(F.col("status"), list(C.PHASE_FLOORS.items())), F.lit(0))
    percent = (
        F.when((F.col("status") == "ready") | F.coalesce(F.col("job_status") == "succeeded", F.lit(False)), 100)
        .when(F.col("status") == "pending", 0)
        .when(F.col("reached").isNull(), floor)
        .otherwise(F.least(F.greatest(F.col("reached"), floor), F.lit(99)))
    )
    return rows.select("document_id", phase.alias("phase"), percent.cast("int").alias("percent"))


def receipt_key(job: Column, step: Column, payload: Column) -> Column:
    """job:step:hash, with the hash of a payload (a struct, or JSON as text) of any shape and order of fields."""
    return F.concat_ws(":", job, step, payload_hash(payload))


def first_of_each(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each idempotency key; the others are answered from it."""
    return latest(rows, key, order)


def batches(rows: DataFrame, order: list[Column], size: int = C.EMBED_BATCH) -> DataFrame:
    """Adds batch: rows in order, ``size`` together.

    Positions come from counts of range partitions, so no single task orders all rows.
    The ranges are written once: counts and rows read the same ones."""
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "batches").save(ranged, "ranged")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = ranged.withColumn("__n", inside)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))  # one row a partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = numbered.join(F.broadcast(before.select("__part", "__before")), "__part")
    return joined.withColumn("batch", F.floor((F.col("__before") + F.col("__n") - 1) / size)).drop("__part", "__n", "__before")


def to_embed(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct contents (sha256, content) that the cache (sha256, vector) lacks: each is embedded once."""
    return chunks.select("sha256", "content").dropDuplicates(["sha256"]).join(cache.select("sha256"), "sha256", "left_anti")


def seed_users(users: DataFrame, keep: DataFrame) -> dict[str, DataFrame]:
    """Accounts to write and to remove so that only ``keep`` (username, role) are left."""
    key = F.lower(F.trim("username"))
    a, b = users.withColumn("key", key), keep.withColumn("key", key).withColumnRenamed("username", "wanted").withColumnRenamed("role", "wanted_role")
    kept = b.join(a, "key", "left").select("key", "wanted", "wanted_role", F.when(F.col("username").isNull(), "insert").otherwise("update").alias("action"))
    return {"write": kept, "remove": a.join(b.select("key"), "key", "left_anti").drop("key")}


def prune_users(removed: DataFrame, heir: int, documents: DataFrame, kbs: DataFrame, audit: DataFrame, sessions: DataFrame, messages: DataFrame, owned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables once the accounts ``removed`` (user_id) are gone: documents (uploader) and bases
    (creator) go to ``heir``, audit rows lose their actor, sessions (session_id, user_id) go with
    their messages, and so do the rows of ``owned`` (user_id)."""
    gone = removed.select("user_id").distinct()

    def instead(rows: DataFrame, column: str, value: Column) -> DataFrame:
        marked = rows.join(gone.select(F.col("user_id").alias(column), F.lit(True).alias("__gone")), column, "left")
        return marked.withColumn(column, F.when(F.col("__gone"), value).otherwise(F.col(column))).select(*rows.columns)

    dead = sessions.join(gone, "user_id", "left_semi").select("session_id")
    return {
        "documents": instead(documents, "uploader", F.lit(heir)), "kbs": instead(kbs, "creator", F.lit(heir)), "audit": instead(audit, "actor", F.lit(None)),
        "sessions": sessions.join(gone, "user_id", "left_anti"), "messages": messages.join(dead, "session_id", "left_anti"),
    } | {name: rows.join(gone, "user_id", "left_anti") for name, rows in owned.items()}


def protected(actor: Column, target: Column, new_role: Column, new_active: Column) -> Column:
    """Reason why an admin may not change an account: their own role or state. Null if they may."""
    own = actor == target
    return F.when(own & (new_role != "admin"), "own_role").when(own & ~new_active, "own_state")


def client_ip(forwarded: Column, peer: Column) -> Column:
    """First address of the forwarded header, else the peer's."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)
