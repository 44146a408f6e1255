"""Board analytics over run records: rankings, cohorts, families, cost, notes, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.functions import text, typed
from tapelake.operators.ordered import equi_join, neighbour, row_number, running_sum, with_running
from tapelake.session import written
from tapelake.sources.tapes import gate_record, gate_records, once

# --- rankings -----------------------------------------------------------------------


def rankable(outcome: Column, rate: Column, low: Column, high: Column, n: Column) -> Column:
    """SCORED with a usable interval."""
    present = rate.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.coalesce((outcome == "SCORED") & present & (n > 0), F.lit(False))


def dominance_rank(rows: DataFrame, band: Sequence[str], low: str, high: str) -> DataFrame:
    """rank = 1 + how many intervals of the band lie wholly above; tied and group_size count the rows that share the rank.

    One sweep over the sorted ends: a row's high end carries the row and learns how many low ends lie at or below it, which leaves the others
    above. Of equal ends the low ones come first, and a hash of the row spreads equal ones over slices. Rows that share a rank all overlap: no
    low end lies between their high ends, so each one's low end is at or below every other's high end. Low ends may not exceed high ends.
    """
    fields = F.struct(*[F.col(c) for c in rows.columns])
    tie = F.xxhash64(*rows.columns)
    ends = rows.select(*band, F.inline(F.array(
        F.struct(F.col(low).alias("__v"), F.lit(0).alias("__hi"), tie.alias("__tie"), F.lit(None).cast(rows.schema).alias("__row")),
        F.struct(F.col(high).alias("__v"), F.lit(1).alias("__hi"), tie.alias("__tie"), fields.alias("__row")))))
    counted = with_running(ends, band, ["__v", "__hi", "__tie"], F.col("__hi") == 0, "__below", "__all")
    ranked = counted.where("__hi = 1").select("__row.*", (1 + F.col("__all") - F.col("__below")).alias("rank"))
    shared = ranked.groupBy(*band, "rank").agg(F.count(F.lit(1)).alias("group_size"))
    return equi_join(ranked, shared, [*band, "rank"], "inner").withColumn("tied", F.col("group_size") > 1)


def display_order(rows: DataFrame, band: Sequence[str], rate: str, name: str, low: str, high: str) -> DataFrame:
    """Add overlaps_above: does a row's interval overlap that of the row printed before it?

    Order: highest rate first, then name (unique within the band).
    """
    keyed = rows.withColumn("__neg", -F.col(rate))
    near = neighbour(keyed, band, ["__neg", name], {"__low": low, "__high": high}, -1)
    above = (F.col("__low") <= F.col(high)) & (F.col(low) <= F.col("__high"))
    return near.withColumn("overlaps_above", F.coalesce(above, F.lit(False))).drop("__neg", "__low", "__high")


def separation(ranked: DataFrame, band: Sequence[str]) -> DataFrame:
    """Separated pairs of each band out of all pairs; every row is below rank - 1 others."""
    out = ranked.groupBy(*band).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("rank") - 1).alias("separated"))
    return out.withColumn("pairs", (F.col("rows") * (F.col("rows") - 1) / 2).cast("long")).withColumn(
        "all_overlap", (F.col("rows") > 1) & (F.col("separated") == 0))


# --- cohorts --------------------------------------------------------------------------


def cohorts(rows: DataFrame, server: Sequence[str], started: str, tie: str) -> DataFrame:
    """Attempt number and number of runs of the same server (never NULL), by start.

    Runs with no start come after the dated ones, in file order.
    """
    keyed = rows.withColumn("__undated", F.col(started).isNull())
    placed = row_number(keyed, server, ["__undated", started, tie], "attempt").drop("__undated")
    totals = rows.groupBy(*server).agg(F.count(F.lit(1)).alias("runs"))
    return equi_join(placed, totals, server, "inner", nulls=False)


def rerun_summary(rows: DataFrame, server: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Servers run more than once and the rows they account for."""
    per = rows.groupBy(*by, *[c for c in server if c not in by]).agg(F.count(F.lit(1)).alias("n"))
    again = F.col("n") > 1
    return per.groupBy(*by).agg(
        F.count_if(again).alias("servers"), F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("total_servers"))


def unique_names(rows: DataFrame, base: str, order: str, name: str) -> DataFrame:
    """Number repeated names in order: x, x-2, x-3 ..., stepping over names already taken.

    One pass over each base names almost everything. Only where a base looks
    like a numbered name of another ("x-2") can two rows meet; then the earliest
    keeps the name and the later ones count on, until nothing collides. Rows
    still colliding are few, so the rounds stay short.
    """
    def named(df: DataFrame) -> DataFrame:
        return df.withColumn(name, F.when(F.col("__k") == 1, F.col(base)).otherwise(
            F.concat_ws("-", base, F.col("__k").cast("string"))))

    out = named(row_number(rows, [base], [order], "__k"))
    while True:
        again = out.groupBy(name).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")).where("__n > 1")
        if again.isEmpty():
            return out.drop("__k")
        clash = equi_join(out, again.drop("__n"), [name], "left")
        moved = F.coalesce(F.col(order) > F.col("__first"), F.lit(False))
        out = written(named(clash.withColumn("__k", F.col("__k") + moved.cast("long")).drop("__first")), "names")


# --- refusals and families ---------------------------------------------------------------

TIERS = ("free", "cheap", "paid")
LADDER = ("free", "cheap", "paid", "unclassified", "scored")


def refusing_record(r: Column) -> Column:
    """The record of the gate that refused, else the first failed record."""
    refused_at = typed.raw_text(r, "$.gates.refusedAt")
    records = gate_records(r)
    named = F.get(F.filter(records, lambda g: F.coalesce(typed.raw_text(g, "$.gate") == refused_at, F.lit(False))), F.lit(0))
    failed = F.get(F.filter(records, lambda g: ~F.coalesce(typed.flag(g, "$.ok"), F.lit(True))), F.lit(0))
    return F.coalesce(named, failed)


def refusals(reports: DataFrame) -> DataFrame:
    """Add gate, reason, cost_tier and family of each report (NULL gate when scored)."""
    rec = refusing_record(F.col("r"))
    refused = F.col("outcome") != "SCORED"
    rows = reports.withColumn("__rec", F.when(refused, rec))
    tier = typed.text("__rec", "$.costTier")
    gate = F.coalesce(typed.text("__rec", "$.gate"), F.when(refused, typed.text("r", "$.gates.refusedAt")))
    return rows.select(
        "*", gate.alias("gate"), typed.text("__rec", "$.reason").alias("reason"), tier.alias("cost_tier"),
        family(F.col("outcome"), tier).alias("family")).drop("__rec")


def family(outcome: Column, tier: Column) -> Column:
    return F.when(outcome == "SCORED", "scored").when(tier.isin(*TIERS), tier).otherwise("unclassified")


def ladder_place(key: Column, ladder: Sequence[str] = LADDER) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ladder]), key)


def family_buckets(rows: DataFrame, bucket: str, code: str, gate: str | None = None,
                   generator: str | None = None) -> DataFrame:
    """Per family: rows, its outcome codes by count, its distinct gates and generators."""
    coded = rows.groupBy(bucket, code).agg(F.count(F.lit(1)).alias("n"))
    out = coded.groupBy(bucket).agg(F.sum("n").alias("count"), F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(code).alias("code")))),
        lambda e: F.struct(e["code"].alias("code"), (-e["neg"]).alias("count"))).alias("codes"))
    for column, name in ((gate, "gates"), (generator, "generators")):
        if column:
            seen = rows.select(bucket, column).where(F.col(column).isNotNull()).distinct().groupBy(bucket).agg(
                F.array_sort(F.collect_list(column)).alias(name))
            out = equi_join(out, seen, [bucket], "left")
    return out


def first_failing(rows: DataFrame, keys: Sequence[str], order: str, failed: Column, columns: Sequence[str]) -> DataFrame:
    """The first failing row of each group, as columns; NULLs when nothing failed."""
    pick = F.min_by(F.when(failed, F.struct(*columns)), F.when(failed, F.col(order)))
    return rows.groupBy(*keys).agg(pick.alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in columns])


def failed_gates(reports: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Failed gates of refused runs: the refusing one first, both surface gates as one,
    hygiene left out."""
    rows = reports.where("outcome <> 'SCORED'").select(
        *keys, typed.raw_text("r", "$.gates.refusedAt").alias("refused_at"),
        F.posexplode(gate_records(F.col("r"))).alias("seq", "g"))
    gate = typed.text("g", "$.gate")
    failed = rows.where(~F.coalesce(typed.flag("g", "$.ok"), F.lit(True)) & ~F.coalesce(
        gate == "protocol_hygiene", F.lit(False)))
    failed = failed.select(*keys, "seq", gate.alias("gate"), typed.text("g", "$.reason").alias("reason"),
                           (gate == F.col("refused_at")).alias("refuses"))
    first = failed.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("refuses"), F.col("seq"))), F.min("seq")).alias("__primary"))
    told = equi_join(failed, first, keys, "left").withColumn(
        "__place", F.when(F.col("seq") == F.col("__primary"), -1).otherwise(F.col("seq"))).withColumn(
        "story", F.when(F.col("gate").isin("structural", "suite_size"), "surface").otherwise(
            F.concat_ws(":", "gate", F.col("seq").cast("string"))))
    one = told.groupBy(*keys, "story").agg(F.min_by(F.struct("gate", "reason"), "__place").alias("s"),
                                           F.min("__place").alias("__place"))
    return row_number(one, keys, ["__place"], "story_no").select(*keys, "story_no", "s.*")


def decisive(reports: DataFrame) -> DataFrame:
    """The counts that decided each run: k of n, and two rates for a null refusal."""
    r = F.col("r")
    null, structural, built = (gate_record(r, g) for g in ("null_baseline", "structural", "construct"))
    return refusals(reports).select(
        "run_id", "slug", "outcome", "gate",
        F.when(F.col("outcome") == "SCORED", F.col("first_try.k")).when(
            F.col("gate").isin("structural", "suite_size"), typed.num(structural, "$.detail.nGenerated")).when(
            F.col("gate") == "construct", typed.num(built, "$.verdict.k")).alias("k"),
        F.when(F.col("outcome") == "SCORED", F.col("first_try.n")).when(
            F.col("gate").isin("structural", "suite_size"), typed.num(structural, "$.detail.nRequested")).when(
            F.col("gate") == "construct", typed.num(built, "$.verdict.n")).alias("n"),
        F.when(F.col("gate") == "null_baseline", typed.num(null, "$.detail.tNull")).alias("noise"),
        F.when(F.col("gate") == "null_baseline", typed.num(null, "$.detail.tAblate")).alias("signal"))


# --- cost ------------------------------------------------------------------------------------


def _sum_known(entries: Column, name: str) -> Column:
    known = F.filter(F.transform(entries, lambda e: e[name]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b))


def judge_usage(reports: DataFrame) -> DataFrame:
    """Add judge: struct of presence, sums over the entries that report a figure, and gaps."""
    r = F.col("r")
    spots = ("$.judgeUsage", "$.judge_usage", "$.run.judgeUsage", "$.run.judge_usage", "$.score.judgeUsage",
             "$.trace_stats.judgeUsage")
    block = F.coalesce(*[F.when(typed.present(r, p), typed.at(r, p)) for p in spots])
    rows = reports.withColumn("__j", block)
    j = F.col("__j")
    listed = F.coalesce(typed.items(j), typed.items(j, "$.entries"), typed.items(j, "$.perPhase"),
                        typed.items(j, "$.usages"))
    single = F.array(typed.usage_entry(j))
    entries = F.filter(F.when(listed.isNotNull(), F.transform(listed, typed.usage_entry)).otherwise(single),
                       lambda e: e.isNotNull())
    by_model = F.filter(F.transform(typed.items(j, "$.byModel"), typed.usage_entry), lambda e: e.isNotNull())
    unpriced = F.transform(F.filter(by_model, lambda e: e["cost_usd"].isNull()),
                           lambda e: F.coalesce(e["model"], F.lit("unnamed model")))
    rows = rows.withColumn("__e", F.coalesce(entries, F.array().cast(
        "array<struct<model:string,phase:string,calls:double,input_tokens:double,output_tokens:double,cost_usd:double>>")))
    e = F.col("__e")
    return rows.withColumn("judge", F.struct(
        (F.size(e) > 0).alias("present"), *[_sum_known(e, c).alias(c) for c in (
            "calls", "input_tokens", "output_tokens", "cost_usd")],
        F.coalesce(typed.flag(j, "$.partial"), F.lit(False)).alias("partial"),
        typed.num(j, "$.uncountedCalls").alias("uncounted_calls"), typed.num(j, "$.failedCalls").alias("failed_calls"),
        F.coalesce(unpriced, F.array().cast("array<string>")).alias("unpriced_models"))).drop("__j", "__e")


def null_screen_of(r: Column) -> Column:
    structural = gate_record(r, "structural")
    sizing = gate_record(r, "suite_size")
    shown = lambda n, s: F.coalesce(
        typed.num(sizing, f"$.detail.{n}"), typed.num(structural, f"$.detail.{n}"),
        typed.num(structural, f"$.detail.synthesis.nullScreen.{s}"))
    screen = "$.detail.synthesis.nullScreen"
    return F.struct(
        (F.coalesce(typed.flag(structural, f"{screen}.enabled"), F.lit(False))
         | F.coalesce(typed.flag(r, "$.run.nullScreenEnabled"), F.lit(False))).alias("enabled"),
        shown("nullScreenDropped", "dropped").alias("dropped"), shown("nullScreenScreened", "screened").alias("screened"),
        typed.num(structural, f"{screen}.errors").alias("errors"),
        typed.num(structural, f"{screen}.inputTokens").alias("input_tokens"),
        typed.num(structural, f"{screen}.outputTokens").alias("output_tokens"),
        typed.text(sizing, "$.detail.attribution").alias("attribution"))


def model_activity(r: Column) -> Column:
    models = F.filter(F.transform(typed.items(r, "$.trace_stats.models.cost.unpricedModels"), lambda m: typed.text(m)),
                      lambda m: m.isNotNull())
    return F.struct(
        F.coalesce(typed.num(r, "$.trace_stats.models.summary.assistantTurns"), F.lit(0.0)).alias("assistant_turns"),
        typed.num(r, "$.trace_stats.models.cost.totalUsd").alias("cost_usd"),
        F.coalesce(models, F.array().cast("array<string>")).alias("unpriced_models"),
        F.coalesce(typed.flag(r, "$.trace_stats.models.cost.partial"), F.lit(False)).alias("partial"))


def null_safe_sum(*parts: Column) -> Column:
    """Sum of the known parts; NULL when none is known."""
    known = F.coalesce(*parts).isNotNull()
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(known, total)


def floor_reasons(*reasons: tuple[Column, str]) -> Column:
    """The names of the gaps that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in reasons]))


def run_costs(reports: DataFrame) -> DataFrame:
    """Runner and judge dollars of each run, what is known to be missing, floor or complete."""
    rows = judge_usage(reports).withColumn("activity", model_activity(F.col("r"))).withColumn(
        "screen", null_screen_of(F.col("r")))
    j, s, a = F.col("judge"), F.col("screen"), F.col("activity")
    rows = rows.withColumn("runner_usd", a["cost_usd"]).withColumn("judge_usd", j["cost_usd"])
    rows = rows.withColumn("total_usd", null_safe_sum(F.col("runner_usd"), F.col("judge_usd")))
    rows = rows.withColumn("excluded", floor_reasons(
        (j["cost_usd"].isNull() & j["present"], "judge usage unpriced"),
        (j["cost_usd"].isNull() & ~j["present"], "judge usage not recorded"),
        (j["partial"], "judge usage partial"), (F.size(j["unpriced_models"]) > 0, "judge model unpriced"),
        (j["uncounted_calls"] > 0, "judge calls uncounted"), (j["failed_calls"] > 0, "judge calls failed"),
        (s["enabled"] & (s["screened"] > 0), "null screen calls"),
        (F.size(a["unpriced_models"]) > 0, "tape model unpriced"), (a["partial"], "tape cost partial")))
    return with_floor(rows, "total_usd", "excluded")


def with_floor(rows: DataFrame, total: str, reasons: str) -> DataFrame:
    known = F.col(total).isNotNull()
    gaps = F.size(reasons) > 0
    return rows.withColumn("complete", known & ~gaps).withColumn("floor", known & gaps)


def board_totals(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over runs; a sum with a floor in it is a floor. Needs total_usd and floor."""
    priced = F.col("total_usd").isNotNull()
    out = costs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total_usd").alias("cost_usd"), F.count_if(priced).alias("cost_runs"),
        F.count_if(F.col("floor")).alias("floor_runs"))
    return out.withColumn("cost_is_floor", (F.col("cost_runs") > 0) & (F.col("floor_runs") > 0))


def board_stats(reports: DataFrame) -> DataFrame:
    """One row: the board's totals."""
    c = run_costs(reports)
    s, j = F.col("screen"), F.col("judge")
    screened = s["enabled"] & (F.coalesce(s["screened"], F.lit(0.0)) > 0)
    return c.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("outcome") == "SCORED").alias("scored"),
        F.countDistinct("slug").alias("servers"), F.sum("total_usd").alias("cost_usd"),
        F.count("total_usd").alias("cost_runs"), F.count_if("floor").alias("floor_runs"),
        F.count_if(F.col("activity.assistant_turns") > 0).alias("turn_runs"),
        F.count_if(F.size("activity.unpriced_models") > 0).alias("unpriced_runs"),
        F.count_if(j["present"]).alias("judge_runs"), F.count("judge_usd").alias("judge_priced_runs"),
        F.sum("judge_usd").alias("judge_usd"), F.count_if(screened).alias("screen_runs"),
        F.coalesce(F.sum(F.when(screened, s["screened"])), F.lit(0.0)).alias("screen_calls"),
        F.coalesce(F.sum(F.when(screened, s["input_tokens"])), F.lit(0.0)).alias("screen_input_tokens"),
        F.coalesce(F.sum(F.when(screened, s["output_tokens"])), F.lit(0.0)).alias("screen_output_tokens"),
    ).withColumn("refused", F.col("runs") - F.col("scored")).withColumn(
        "cost_is_floor", (F.col("cost_runs") > 0) & (F.col("floor_runs") > 0))


def spend_until(rows: DataFrame, order: Sequence[str], usd: str, ceiling: float, reserve: float,
                keys: Sequence[str]) -> DataFrame:
    """Cumulative spend and whether one more worst-case run still fits under the ceiling."""
    out = running_sum(rows, keys, order, {"cum_usd": F.coalesce(F.col(usd), F.lit(0.0))})
    return out.withColumn("may_continue", F.col("cum_usd") + reserve <= ceiling)


# Fixed value: what a run's judge is taken to cost when its record does not say, in USD.
JUDGE_GUESS_USD = 0.42


def spend_entries(reports: DataFrame) -> DataFrame:
    """One ledger row per run: runner and judge dollars, whether the judge was measured, result.

    Only the estimate uses the guess; judge_usd stays NULL where it was not measured.
    """
    per = F.coalesce(typed.items("r", "$.trace_stats.models.perModel"), F.array().cast("array<variant>"))
    runner = F.aggregate(per, F.lit(0.0), lambda a, m: a + F.coalesce(typed.num(m, "$.estCostUsd"), F.lit(0.0)))
    judge = typed.num("r", "$.run.judgeUsage.estCostUsd")
    return reports.select(
        "slug", "run_id", "outcome", typed.text("r", "$.gates.refusedAt").alias("refused_at"),
        F.round(runner, 4).alias("runner_usd"), F.round(judge, 4).alias("judge_usd"), judge.isNotNull().alias("judge_measured"),
        F.round(runner + F.coalesce(judge, F.lit(JUDGE_GUESS_USD)), 4).alias("est_usd"),
        F.col("first_try.k").alias("first_try_k"), F.col("first_try.n").alias("first_try_n"),
        F.size(typed.items("r", "$.score.tasks")).alias("tasks"))


# --- hygiene, tools ---------------------------------------------------------------------------


def report_findings(reports: DataFrame) -> DataFrame:
    rows = reports.select("run_id", "slug", F.explode(typed.items("r", "$.probes.findings")).alias("f"))
    return rows.where(typed.is_object(F.col("f"))).select(
        "run_id", "slug", typed.text("f", "$.id").alias("id"), typed.flag("f", "$.pass").alias("pass"))


def tool_totals(r: Column) -> Column:
    tools = F.coalesce(typed.items(r, "$.trace_stats.tools"), F.array().cast("array<variant>"))
    add = lambda f: F.aggregate(tools, F.lit(0.0), lambda a, t: a + F.coalesce(typed.num(t, f"$.{f}"), F.lit(0.0)))
    return F.struct(F.size(tools).alias("names"), *[add(f).alias(f) for f in ("calls", "errors", "pending")])


def advertised_tools(r: Column) -> Column:
    counts = F.filter(F.transform(typed.items(r, "$.probes.findings"), lambda f: typed.num(f, "$.evidence.toolCount")),
                      lambda c: c.isNotNull())
    return F.coalesce(F.get(counts, F.lit(0)), typed.num(gate_record(r, "suite_size"), "$.detail.toolCount"))


def spec_currency(r: Column) -> Column:
    era = typed.text(r, "$.server.era")
    return F.struct(typed.text(r, "$.probes.specCurrency").alias("version"),
                    F.when(era.isin("modern", "legacy"), era).alias("era"))


# --- lineage -----------------------------------------------------------------------------------

# Labels of the named lineage fields, in reading order.
LINEAGE = {
    "suiteVersion": "suite version", "suiteGeneration": "suite generation", "parentSuiteHash": "parent suite hash",
    "sourceSuiteHash": "source suite hash", "previousSuiteHash": "previous suite hash", "parentRunId": "parent run",
    "derivedFrom": "derived from", "regeneratedFrom": "regenerated from", "extendedFrom": "extended from",
    "generatorModel": "generator model", "generatorSeed": "generator seed", "seed": "generator seed",
    "promptVersion": "generator prompt version"}


def lineage(reports: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(keys, place, label, value): named fields first across all sources, then the rest
    of the lineage blocks; the first row of a label wins."""
    synthesis = typed.at(gate_record(F.col("r"), "structural"), "$.detail.synthesis")
    blocks = [typed.obj("r", p) for p in ("$.run.suiteLineage", "$.run.lineage", "$.suiteLineage")] + [
        typed.obj(synthesis, "$.lineage"), typed.obj(synthesis, "$.suiteLineage")]
    sources = [typed.obj("r", "$.run"), typed.obj(synthesis), *blocks]
    named = [F.struct(F.lit(i * 10 + j).alias("place"), F.lit(k).alias("key"),
                      typed.scalar(src, f"$.{k}").alias("value"))
             for i, k in enumerate(LINEAGE) for j, src in enumerate(sources)]

    def rest(block: Column, place: int) -> Column:
        entries = F.map_entries(F.try_variant_get(block, "$", "map<string,variant>"))
        return F.coalesce(F.transform(entries, lambda e: F.struct(
            F.lit(place).alias("place"), e["key"].alias("key"), typed.scalar(e["value"]).alias("value"))),
            F.array().cast("array<struct<place:int,key:string,value:string>>"))

    everything = F.concat(F.array(*named), *[rest(b, 1000 + i) for i, b in enumerate(blocks)])
    labels = F.create_map(*[F.lit(x) for kv in LINEAGE.items() for x in kv])
    rows = reports.select(*keys, F.explode(everything).alias("e")).where("e.value <> ''")
    plain = F.lower(F.regexp_replace(F.regexp_replace("e.key", "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
    rows = rows.select(*keys, "e.place", F.coalesce(F.try_element_at(labels, F.col("e.key")), plain).alias("label"),
                       F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    return rows.groupBy(*keys, "label").agg(
        F.min("place").alias("place"), F.min_by("value", F.struct("place", "key")).alias("value"))


# --- notes ---------------------------------------------------------------------------------------


def standing_notes(notes: DataFrame, group: Sequence[str], run: Sequence[str], note: str) -> DataFrame:
    """Notes every run of a group carries, for groups of two runs or more.

    notes holds one row per run and note; a run without notes has a row with NULL.
    """
    runs = notes.select(*group, *run).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("__runs"))
    carried = notes.where(F.col(note).isNotNull()).select(*group, *run, note).distinct().groupBy(
        *group, note).agg(F.count(F.lit(1)).alias("__have"))
    return equi_join(carried, runs, group, "inner").where("__runs >= 2 AND __have = __runs").select(*group, note)


def own_notes(notes: DataFrame, standing: DataFrame, group: Sequence[str], note: str) -> DataFrame:
    """Notes that are not standing; repeats within a run stay."""
    return equi_join(notes.where(F.col(note).isNotNull()), standing, [*group, note], "left_anti")


# --- extensions -----------------------------------------------------------------------------------


POOL = f"struct<{typed.COUNT_FIELDS}>"
DROPS = ("nullScreen", "answerLeak", "admission", "duplicate")
LISTS = ("extensions", "extensionBatches", "batches")
VERDICTS = ("verdictAfter", "outcome", "verdict", "result", "resolution")
BATCH = (f"struct<`index` variant, pooledBefore {POOL}, pooledAfter {POOL}, dropped struct<{', '.join(f'{d} variant' for d in DROPS)}>, "
         f"{typed.COUNT_FIELDS}, verdictBefore variant, {', '.join(f'{f} variant' for f in VERDICTS)}, seed variant, admitted variant, "
         "violations array<variant>, taskIds array<variant>>")


def listed_batches(r: Column) -> Column:
    """A report's extension batches, each with its gate and its place in the list it stands in.

    The run's own ledger counts; a gate it says nothing about is read from the
    lists on that gate's record.
    """
    none = F.array().cast("array<variant>")
    empty = F.array().cast("array<struct<gate:string,seq:int,x:variant>>")
    row = lambda gate: lambda e, i: F.struct(gate(e).alias("gate"), i.cast("int").alias("seq"), e.alias("x"))
    own = F.transform(F.coalesce(typed.items(r, "$.gates.extensions"), none),
                      row(lambda e: F.coalesce(typed.text(e, "$.gate"), F.lit("construct"))))

    def noted(told: Column, g: Column) -> Column:
        shape = f"struct<gate variant, detail struct<{', '.join(f'{f} array<variant>' for f in LISTS)}>, extensions array<variant>>"
        lists = lambda s: F.coalesce(*[s["detail"][f] for f in LISTS], s["extensions"])
        return typed.let(typed.shaped(g, shape), lambda s: F.when(lists(s).isNotNull(), typed.let(typed.text(s["gate"]), lambda gate: F.when(
            ~F.array_contains(told["gate"], F.coalesce(gate, F.lit(""))), F.transform(lists(s), row(lambda _: gate))))))

    return typed.let(own, lambda told: F.concat(told, F.flatten(F.transform(
        gate_records(r), lambda g: F.coalesce(noted(told, g), empty)))))


def extension_batches(reports: DataFrame) -> DataFrame:
    """One row per consumed extension: its counts, the pool on both sides, drops and violations.

    A report is gone through once (see listed_batches), and each of its batches is read once.
    """
    policy = typed.shaped("r", "struct<maxExtensions variant, extensionSize variant>", "$.gates.extensionPolicy")
    head = once(reports.select("run_id", "outcome", "r"), policy, "p")
    rows = head.select("run_id", "outcome", typed.num("p.maxExtensions").alias("most"), typed.num("p.extensionSize").alias("size"),
                       F.inline(listed_batches(F.col("r"))))
    rows = once(rows, typed.shaped("x", BATCH), "s")
    s = F.col("s")
    rows = once(rows.drop("x"), F.struct(typed.counts_of(s["pooledBefore"]).alias("before"), typed.counts_of(s["pooledAfter"]).alias("after"),
                                         typed.counts_of(s).alias("direct")), "c")
    before, after, direct = (F.col(f"c.{n}") for n in ("before", "after", "direct"))
    moved = (after["n"] > before["n"]) & (after["k"] >= before["k"])
    derived = F.when(moved, F.struct((after["k"] - before["k"]).alias("k"), (after["n"] - before["n"]).alias("n")))
    drops = null_safe_sum(*[typed.num(s["dropped"][d]) for d in DROPS])
    none = F.array().cast("array<variant>")
    return rows.select(
        "run_id", "outcome", "most", "size", "seq", "gate",
        F.coalesce(typed.num(s["index"]), F.col("seq") + 1).alias("index"), before.alias("before"),
        after.alias("after"), F.coalesce(direct, derived).alias("counts"),
        (direct.isNull() & derived.isNotNull()).alias("derived_from_pool"),
        typed.text(s["verdictBefore"]).alias("verdict_before"),
        F.coalesce(*[typed.text(s[f]) for f in VERDICTS]).alias("verdict_after"),
        typed.num(s["seed"]).alias("seed"), typed.num(s["admitted"]).alias("admitted"),
        F.coalesce(drops, F.lit(0.0)).alias("dropped"),
        F.size(F.coalesce(s["violations"], none)).alias("violations"),
        texts_of(s["taskIds"]).alias("task_ids"))


def texts_of(items: Column) -> Column:
    return F.filter(F.transform(items, lambda t: typed.text(t)), lambda t: t.isNotNull())


def extensions_counted(reports: DataFrame) -> DataFrame:
    """(run_id, gate, consumed): extensions a record only counts, without listing them."""
    rows = reports.select("run_id", F.explode(gate_records(F.col("r"))).alias("g"))
    n = typed.first_num(typed.at("g", "$.detail"), "extensionsUsed", "extensionsConsumed", "extensionCount")
    return rows.select("run_id", typed.text("g", "$.gate").alias("gate"), n.alias("consumed")).where("consumed > 0")


def extension_ledger(batches: DataFrame, keys: Sequence[str] = ("run_id", "gate")) -> DataFrame:
    """Per run and gate: batches consumed, the registered counts, the pool and whether
    the policy is used up. Without a recorded start it is the pool less its batches."""
    out = batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("consumed"), F.min_by("before", "seq").alias("first_before"),
        F.max_by("after", "seq").alias("pooled"), F.sum("counts.k").alias("k"), F.sum("counts.n").alias("n"),
        F.bool_and(F.col("counts").isNotNull()).alias("all_counted"), F.max("most").alias("most"))
    can = F.col("all_counted") & (F.col("pooled.n") > F.col("n")) & (F.col("pooled.k") >= F.col("k"))
    derived = F.when(can, F.struct((F.col("pooled.k") - F.col("k")).alias("k"), (F.col("pooled.n") - F.col("n")).alias("n")))
    return out.select(
        *keys, "consumed", F.coalesce("first_before", derived).alias("initial"),
        (F.col("first_before").isNull() & derived.isNotNull()).alias("initial_derived"), "pooled",
        F.coalesce(F.col("consumed") >= F.col("most"), F.lit(False)).alias("exhausted"))


def extension_protocol(reports: DataFrame) -> DataFrame:
    """What each record says about its extension policy, and what it consumed."""
    size = typed.num("r", "$.gates.extensionPolicy.extensionSize")
    most = typed.num("r", "$.gates.extensionPolicy.maxExtensions")
    listed = typed.items("r", "$.gates.extensions")
    detail = F.exists(gate_records(F.col("r")), lambda g: (
        typed.text(g, "$.detail.extensionProtocol").isNotNull() | typed.num(g, "$.detail.extensionsConsumed").isNotNull()
        | typed.items(g, "$.detail.extensions").isNotNull() | typed.obj(g, "$.detail.pooled.policy").isNotNull()))
    return reports.select(
        "run_id", size.alias("extension_size"), most.alias("max_extensions"),
        (F.coalesce(detail, F.lit(False)) | listed.isNotNull()).alias("stated"),
        F.coalesce((size > 0) & (most > 0), F.lit(False)).alias("registered"),
        F.coalesce(F.when(listed.isNotNull(), F.size(listed)), F.lit(0)).alias("ledger_entries"))


# --- correlation ids and links -------------------------------------------------------------------

# Phases a gate's pass and a null model stamp on their ids.
GATE_PHASES = {"construct": "construct"}
NULL_PHASES = {"no-tools": "null-no-tools", "stubbed-empty": "null-stubbed-empty", "random-valid-args": "null-random"}


def scored_ids(r: Column) -> Column:
    return F.coalesce(texts_of(typed.shaped(r, "array<struct<taskId variant>>", "$.score.tasks")["taskId"]), F.array().cast("array<string>"))


def bought_ids(r: Column) -> Column:
    """The gate and the task ids of each extension batch."""
    ids = lambda b: F.coalesce(texts_of(typed.items(b["x"], "$.taskIds")), F.array().cast("array<string>"))
    return F.transform(listed_batches(r), lambda b: F.struct(b["gate"].alias("gate"), ids(b).alias("ids")))


def task_ids(reports: DataFrame) -> DataFrame:
    """(run_id, task_id) named by a report: scored tasks and extension tasks."""
    r = F.col("r")
    return reports.select("run_id", F.explode(F.concat(scored_ids(r), F.flatten(bought_ids(r)["ids"]))).alias("task_id")).distinct()


def correlation_ids(reports: DataFrame, distinct: bool = True) -> DataFrame:
    """(run_id, corr_id) a report itself gives evidence for, stamped phases included. A report is gone through once; without
    ``distinct`` an id comes back for every report that gives it, which is enough to look ids up in."""
    r = F.col("r")
    records = typed.shaped(
        r, "array<struct<gate variant, detail struct<n variant, rates array<struct<label variant, taskId variant>>>>>", "$.gates.records")
    named = F.transform(records, lambda g: F.struct(typed.text(g["gate"]).alias("gate"), g["detail"].alias("detail")))
    first = lambda gate: F.get(F.filter("p.records", lambda g: F.coalesce(g["gate"] == gate, F.lit(False))), F.lit(0))["detail"]
    rows = once(reports.select("run_id", "r"), F.struct(scored_ids(r).alias("scored"), bought_ids(r).alias("bought"), named.alias("records")), "p")
    rows = rows.select("run_id", "p.scored", "p.bought", first("construct")["n"].alias("n"), first("null_baseline")["rates"].alias("rates"))
    phased = lambda ids, phase: F.transform(ids, lambda t: F.concat(t, F.lit(text.PHASES), phase))
    stamped = F.create_map(*[F.lit(x) for kv in GATE_PHASES.items() for x in kv])
    phases = F.create_map(*[F.lit(x) for kv in NULL_PHASES.items() for x in kv])
    none = F.array().cast("array<string>")
    every = F.concat(
        F.col("scored"), F.flatten("bought.ids"),
        F.flatten(F.transform("bought", lambda b: phased(b["ids"], F.try_element_at(stamped, b["gate"])))),
        F.when(typed.num("n") > 0, phased(F.col("scored"), F.lit("construct"))).otherwise(none),
        F.coalesce(F.transform("rates", lambda n: F.concat(
            typed.text(n["taskId"]), F.lit(text.PHASES), F.try_element_at(phases, typed.text(n["label"])))), none))
    out = rows.select("run_id", F.explode(F.array_compact(every)).alias("corr_id"))
    return out.distinct() if distinct else out


def gate_focus(reports: DataFrame, known: DataFrame) -> DataFrame:
    """(run_id, gate, corr_id): the id a gate's finding can be opened on, if the record carries it."""
    lists = ("leaks", "failures", "offenders")
    shape = ("array<struct<gate variant, detail struct<taskId variant, worstTaskId variant, rates array<struct<label variant, taskId variant>>, "
             f"{', '.join(f'{f} array<variant>' for f in lists)}>>>")
    rows = reports.select("run_id", F.posexplode(typed.shaped("r", shape, "$.gates.records")).alias("seq", "g"))
    rows = once(rows, typed.text("g.gate"), "gate")
    gate, detail = F.col("gate"), F.col("g.detail")

    def listed(field: str) -> Column:
        found = F.transform(detail[field], lambda e: F.coalesce(typed.text(e), typed.first_text(e, "taskId", "task", "id")))
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    phases = F.create_map(*[F.lit(x) for kv in NULL_PHASES.items() for x in kv])
    nulls = F.filter(F.transform(detail["rates"], lambda n: F.concat(
        typed.text(n["taskId"]), F.lit(text.PHASES), F.try_element_at(phases, typed.text(n["label"])))),
        lambda c: c.isNotNull())
    named = F.coalesce(typed.text(detail["taskId"]), typed.text(detail["worstTaskId"]), *[listed(f) for f in lists])
    options = F.when(gate == "null_baseline", nulls).otherwise(typed.let(named, lambda n: F.array_compact(F.array(
        F.when(gate == "construct", F.concat(n, F.lit("::construct"))), n))))
    wanted = rows.select("run_id", "seq", "gate", F.posexplode(options).alias("choice", "corr_id"))
    found = wanted.join(known, ["run_id", "corr_id"], "left_semi")
    return found.groupBy("run_id", "seq", "gate").agg(F.min(F.struct("choice", "corr_id"))["corr_id"].alias("corr_id")).drop("seq")


def named_tasks(prose: DataFrame, ids: DataFrame, prose_ids: Sequence[str], column: str) -> DataFrame:
    """(run_id, prose_ids, task_id): ids whose first occurrence in a text is a whole token.

    A whole token is a maximal run of id characters, so candidates come from an
    equality join on the text's tokens; ids with other characters are looked up
    by their own grams.
    """
    from tapelake.operators.containment import phrase_hits

    simple = F.regexp_like("task_id", F.lit("^[A-Za-z0-9_-]+$"))
    tokens = prose.select("run_id", *prose_ids, F.explode(F.array_distinct(
        F.regexp_extract_all(column, F.lit("[A-Za-z0-9_-]+"), F.lit(0)))).alias("task_id"))
    easy = tokens.join(ids.where(simple).select("run_id", "task_id"), ["run_id", "task_id"])
    odd = phrase_hits(ids.where(~simple).withColumn("__id", F.col("task_id")), prose, ["task_id"], list(prose_ids),
                      "__id", column, 1, ["run_id"])
    found = easy.select("run_id", *prose_ids, "task_id").unionByName(odd.select("run_id", *prose_ids, "task_id"))
    whole = found.join(prose.select("run_id", *prose_ids, column), ["run_id", *prose_ids])
    at = F.position("task_id", column)
    before = F.substring(column, at - 1, F.lit(1))
    after = F.substring(column, at + F.length("task_id"), F.lit(1))
    edge = lambda c: ~F.regexp_like(c, F.lit("[A-Za-z0-9_-]"))
    return whole.where(((at == 1) | edge(before)) & edge(after)).select("run_id", *prose_ids, "task_id")


def sole_owners(classes: DataFrame, keys: Sequence[str], failure: str, tool: str) -> DataFrame:
    """Failure classes that exactly one tool of the group recorded, with that tool."""
    one = classes.groupBy(*keys, failure).agg(F.min(tool).alias(tool), F.max(tool).alias("__other"))
    return one.where(F.col(tool) == F.col("__other")).drop("__other")


def forced_attribution(classes: DataFrame, tasks: DataFrame, declared: DataFrame) -> DataFrame:
    """(run_id, tool, task_id, why): tasks a tool must own.

    classes: run_id, tool, failure, count. tasks: run_id, task_id, failure.
    declared: run_id, tool, task_id named on the tool's own row, which settles
    that tool alone.
    """
    known = tasks.select("run_id", "task_id").distinct()
    stated = declared.join(known, ["run_id", "task_id"], "left_semi").select(
        "run_id", "tool", "task_id", F.lit("declared").alias("why")).distinct()
    owners = sole_owners(classes.where("count > 0"), ["run_id"], "failure", "tool")
    forced = tasks.join(owners, ["run_id", "failure"]).select(
        "run_id", "tool", "task_id", F.lit("only tool with this failure").alias("why"))
    settled = stated.select("run_id", "tool").distinct()
    return stated.unionByName(forced.join(settled, ["run_id", "tool"], "left_anti"))
