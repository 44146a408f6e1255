"""Hygiene findings over recorded frames. NULL means it could not be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import text, typed
from tapelake.operators.ordered import equi_join, neighbour
from tapelake.operators.records import messages

# The probes' own constants.
BOGUS_REVISION = "1999-01-01"
BOGUS_ID = "fitness-probe-bogus-version"
HEADER_ID = "fitness-probe-header-mismatch"
HEADER_CODE = -32020
FINDINGS = ("spec-currency", "bogus-version-accepted", "header-mismatch-accepted", "server-discover-present",
            "cache-hints", "deprecation-surface")


def inconclusive(status: Column) -> Column:
    """Auth walls and outages say nothing about the server."""
    return F.coalesce(status.isin(401, 403) | (status >= 500), F.lit(False))


def bogus_version(status: Column, error: Column, answered: Column) -> Column:
    return (F.when(inconclusive(status), F.lit(None)).when(error, F.lit(True))
            .when(answered.isNull(), F.lit(None)).otherwise(answered != BOGUS_REVISION).cast("boolean"))


def header_mismatch(status: Column, code: Column) -> Column:
    """Pass needs HTTP 400 with the code; without a recorded status nothing is decided."""
    return F.when(status.isNull() | inconclusive(status), F.lit(None).cast("boolean")).otherwise(
        (status == 400) & F.coalesce(code == HEADER_CODE, F.lit(False)))


def cache_hints(ttl: Column, scope: Column, anonymous: Column) -> Column:
    good = ttl.isNotNull() & F.coalesce(scope.isin("public", "private"), F.lit(False))
    return good & ~(F.coalesce(scope == "public", F.lit(False)) & ~anonymous)


def deprecated_surface(tools: DataFrame) -> DataFrame:
    """Per run: tools using deleted vocabulary and tools that call themselves deprecated.

    tools: run_id, definition (JSON text).
    """
    d = F.try_parse_json("definition")
    meta = F.map_keys(F.try_variant_get(typed.obj(d, "$._meta"), "$", "map<string,variant>"))
    marked = (F.coalesce(F.exists(meta, lambda k: F.regexp_like(k, F.lit("(?i)deprecat"))), F.lit(False))
              .cast("int") + F.coalesce(F.regexp_like(
                  typed.text(d, "$.description"), F.lit(r"(?i)\bdeprecat")), F.lit(False)).cast("int"))
    return tools.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tool_count"), F.count_if(typed.at(d, "$.execution").isNotNull()).alias("deleted"),
        F.sum(marked).alias("notes"))


def findings(recs: DataFrame, catalogue: DataFrame, servers: DataFrame) -> DataFrame:
    """(run_id, id, pass): every rule for every run; a rule with no evidence is NULL.

    servers: run_id, revision, anonymous, tasks_capability. HTTP statuses come
    from recorded ``fitness.probe_status`` events; a tape without them leaves
    the status rules undecided.
    """
    raw = F.col("raw")
    out = messages(recs).where((F.col("dir") == "out") & typed.present(raw, "$.id"))
    out = out.withColumn("id", F.try_variant_get(typed.at(raw, "$.id"), "$", "string"))
    asked = messages(recs).where(F.col("dir") == "in").select(
        "run_id", F.try_variant_get(typed.at(raw, "$.id"), "$", "string").alias("id"),
        typed.text(raw, "$.method").alias("method")).where(
        F.col("id").isNotNull() & F.col("method").isin("tools/list", "server/discover"))
    answers = out.join(asked.distinct(), ["run_id", "id"], "left")
    status = recs.where(F.col("kind") == "fitness.probe_status").groupBy("run_id").agg(
        F.max(F.when(typed.text(raw, "$.id") == BOGUS_ID, typed.num(raw, "$.status"))).alias("bogus_status"),
        F.max(F.when(typed.text(raw, "$.id") == HEADER_ID, typed.num(raw, "$.status"))).alias("header_status"))
    is_bogus, is_header = F.col("id") == BOGUS_ID, F.col("id") == HEADER_ID
    listed = (F.col("method") == "tools/list") & typed.obj(raw, "$.result").isNotNull()
    seen = answers.groupBy("run_id").agg(
        F.bool_or(is_bogus).alias("bogus_seen"), F.bool_or(is_header).alias("header_seen"),
        F.max_by(F.when(is_bogus, typed.present(raw, "$.error")), F.when(is_bogus, F.col("line_no"))).alias("bogus_error"),
        F.max_by(F.when(is_bogus, typed.text(raw, "$.result.protocolVersion")),
                 F.when(is_bogus, F.col("line_no"))).alias("bogus_answer"),
        F.max_by(F.when(is_header, typed.num(raw, "$.error.code")), F.when(is_header, F.col("line_no"))).alias("header_code"),
        F.bool_or((F.col("method") == "server/discover") & typed.obj(raw, "$.result").isNotNull()).alias("discovered"),
        F.max_by(F.when(listed, F.struct(typed.num(raw, "$.result.ttlMs").alias("ttl"),
                                         typed.text(raw, "$.result.cacheScope").alias("scope"))),
                 F.when(listed, F.col("line_no"))).alias("hints"))
    surface = deprecated_surface(catalogue)
    rows = servers
    for part in (seen, status, surface):
        rows = equi_join(rows, part, ["run_id"], "left")
    modern = F.coalesce(text.is_modern(F.col("revision")), F.lit(False))
    on_modern = lambda c: F.when(modern, c)
    verdicts = {
        "spec-currency": F.when(F.col("revision").isNotNull(), modern),
        "bogus-version-accepted": F.when(F.col("bogus_seen"), bogus_version(
            F.col("bogus_status"), F.coalesce("bogus_error", F.lit(False)), F.col("bogus_answer"))),
        "header-mismatch-accepted": on_modern(F.when(F.col("header_seen"), header_mismatch(
            F.col("header_status"), F.col("header_code")))),
        "server-discover-present": on_modern(F.coalesce("discovered", F.lit(False))),
        "cache-hints": on_modern(F.when(F.col("hints").isNotNull(), cache_hints(
            F.col("hints.ttl"), F.col("hints.scope"), F.coalesce("anonymous", F.lit(False))))),
        "deprecation-surface": on_modern(F.when(F.col("tool_count").isNotNull(), (
            F.col("deleted") == 0) & ~F.coalesce("tasks_capability", F.lit(False)))),
    }
    listed_rules = F.array(*[F.struct(F.lit(n).alias("id"), verdicts[n].cast("boolean").alias("pass")) for n in FINDINGS])
    return rows.select("run_id", F.explode(listed_rules).alias("f")).select("run_id", "f.*")


def hygiene(rows: DataFrame, keys, passed: str = "pass") -> DataFrame:
    """Passed, failed and could-not-check; unknown never counts as a pass."""
    p = F.col(passed)
    return rows.groupBy(*keys).agg(
        F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"), F.count_if(p.isNull()).alias("unknown"),
        F.count(p).alias("checked"))


def surface_drift(digests: DataFrame, server: str, order: list[str], digest: str) -> DataFrame:
    """Does a listing differ from the server's listing before it? NULL for the first."""
    near = neighbour(digests, [server], order, {"__before": digest}, -1)
    return near.withColumn("drifted", F.col(digest) != F.col("__before")).drop("__before")


def surface_delta(with_credential: Column, without: Column) -> Column:
    """Tools one credential adds and loses."""
    return F.struct(F.array_except(with_credential, without).alias("added"),
                    F.array_except(without, with_credential).alias("removed"))
