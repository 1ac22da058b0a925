"""Queries over clocks, signals and periods."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators import clocks, periods, signals
from sidelines.plans import fixtures as fx
from sidelines.plans.oracles import BASE
from sidelines.plans.queries import shown
from sidelines.plans.registry import query


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.base(spark, sf_dir).withColumn("i", F.row_number().over(fx.ordered(["user_id"], "seg", "seq")) - 1)
    return rows.selectExpr("user_id as match_id", "i * 3000L as ts_ms", "(k % 60) / 100.0D as green_ratio", "(k % 11) / 100.0D as line_score", "cast(100 + k % 120 as double) as sharpness", "cast(60 + k % 130 as double) as brightness", "(k % 50) / 125.0D as motion_score")


@query(
    BASE + """,
feats as (select user_id as match_id, (k % 60) / 100.0::double as g, (k % 11) / 100.0::double as l, (100 + k % 120)::double as sharp, (60 + k % 130)::double as light, (k % 50) / 125.0::double as m from base),
sig as (select *, least(1.0::double, greatest(0.0::double, g * 1.55::double + l * 1.2::double)) as fs, m > 0.32::double as cut from feats),
means as (select match_id, avg(sharp) as sharpness, avg(light) as brightness, avg(fs) as field_score, avg((fs >= 0.25::double)::int) as field_presence, avg(cut::int) as rate, count(*) as sample_count, 1280 + 640 * (match_id % 2) as w, 720 + 360 * (match_id % 2) as h from sig group by match_id),
scored as (select *, 100 * (least(1.0::double, w * h / 2073600.0::double) * 0.24::double + least(1.0::double, sharpness / 180) * 0.22::double + greatest(0.0::double, 1 - abs(brightness - 125) / 125) * 0.14::double + field_score * 0.20::double + field_presence * 0.12::double + greatest(0.0::double, 1 - rate * 4) * 0.08::double) as raw from means)
select match_id, w || 'x' || h as resolution, round(sharpness, 2) as sharpness, round(brightness, 2) as brightness, round(field_score, 4) as field_score, round(field_presence, 4) as field_presence, round(rate, 4) as scene_cut_rate, sample_count, round(raw, 2) as score,
  case when raw >= 78 and w >= 1920 then 'A' when raw >= 60 and w >= 1280 then 'B' when raw >= 40 then 'C' else 'reject' end as grade from scored"""
)
def quality_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    videos = rows.select("match_id").distinct().selectExpr("match_id", "1280 + 640 * (match_id % 2) as width", "720 + 360 * (match_id % 2) as height")
    return signals.quality_report(signals.derive_signals(rows), videos)


ON_FIELD = "case match_id % 4 when 0 then i between 3 and 30 or i between 36 and 64 when 1 then i between 3 and 26 or i between 40 and 64 when 2 then i between 3 and 66 else i % 9 = 0 end"


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A recording per user, each event a sample 100 s after the one before: with a break near the middle, with a long one,
    with none, or with hardly any field."""
    rows = fx.base(spark, sf_dir).withColumn("i", F.row_number().over(fx.ordered(["user_id"], "seq")) - 1).withColumnRenamed("user_id", "match_id")
    rows = rows.selectExpr("match_id", "i * 100000L as ts_ms", f"if({ON_FIELD}, 0.4D + (k % 30) / 97.0D, 0.02D) as field_score")
    return rows, rows.groupBy("match_id").agg(F.max("ts_ms").alias("last_ms")).selectExpr("match_id", "last_ms + 100000 - match_id % 3 * 37000 as duration_ms")


RECORDINGS = BASE + f""",
sig as (select match_id, i * 100000 as ts_ms, case when {ON_FIELD} then 0.4::double + (k % 30) / 97.0::double else 0.02::double end as fs from (select user_id as match_id, k, row_number() over (partition by user_id order by seq) - 1 as i from base)),
vids as (select match_id, max(ts_ms) + 100000 - match_id % 3 * 37000 as d, count(*) as samples from sig group by match_id),
seen as (select *, max(case when fs >= 0.24::double then ts_ms end) over w as last_on from sig window w as (partition by match_id order by ts_ms)),
numbered as (select *, sum(case when ts_ms - last_on > 75000 then 1 else 0 end) over (partition by match_id order by ts_ms) as block from seen),
blocks0 as (select match_id, block, min(ts_ms) as start_ms, case when block = any_value(top) then least(any_value(d), max(ts_ms) + 100000) else max(ts_ms) + 100000 end as end_ms, avg(fs) as confidence
  from (select *, max(block) over (partition by match_id) as top from numbered) join vids using (match_id) where fs >= 0.24::double group by match_id, block),
blocks as (select match_id, start_ms, end_ms, confidence from blocks0 where end_ms - start_ms >= 720000)"""


@query(RECORDINGS + " select match_id, start_ms, end_ms, round(confidence, 6) as confidence from blocks")
def field_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(periods.field_blocks(*recordings(spark, sf_dir)))


@query(
    RECORDINGS + """,
flags as (select *, fs >= 0.24::double as is_on, lag(ts_ms) over w as b_ms, lead(ts_ms) over w as a_ms, lag(fs >= 0.24::double) over w as b_on, lead(fs >= 0.24::double) over w as a_on,
  fs < 0.24::double and ts_ms between trunc(d * 0.35::double) and trunc(d * 0.65::double) as off from sig join vids using (match_id) where samples >= 8 window w as (partition by match_id order by ts_ms)),
cuts as (select *, sum(case when off and not coalesce(p_off, false) then 1 else 0 end) over (partition by match_id order by ts_ms) as run from (select *, lag(off) over (partition by match_id order by ts_ms) as p_off from flags)),
breaks as (select match_id, run, arg_min(b_ms, ts_ms) as b_ms, arg_min(b_on, ts_ms) as b_on, arg_max(a_ms, ts_ms) as a_ms, arg_max(a_on, ts_ms) as a_on from cuts where off group by match_id, run),
long as (select * from breaks where b_on and a_on and a_ms - b_ms between 180000 and 1200000),
held as (select l.*, (select avg((fs >= 0.24::double)::int) from sig s where s.match_id = l.match_id and s.ts_ms between l.b_ms - 240000 and l.b_ms) as b_ratio,
  (select avg((fs >= 0.24::double)::int) from sig s where s.match_id = l.match_id and s.ts_ms between l.a_ms and l.a_ms + 240000) as a_ratio from long l),
scored as (select *, greatest(0.0::double, 1 - abs((b_ms + a_ms) / 2.0::double - d / 2.0::double) / (d * 0.15::double)) * 0.55::double + least(1.0::double, (a_ms - b_ms) / 120000.0::double) * 0.25::double + (b_ratio + a_ratio) / 2 * 0.20::double as score from held join vids using (match_id) where least(b_ratio, a_ratio) >= 0.45::double),
best as (select *, row_number() over (partition by match_id order by score desc, b_ms) as rn from scored),
ends as (select match_id, min(ts_ms) as f, least(any_value(d), max(ts_ms) + 100000) as l from sig join vids using (match_id) where fs >= 0.24::double group by match_id),
central as (select match_id, f as s1, b_ms as e1, a_ms as s2, l as e2, least(0.85::double, 0.55::double + score * 0.30::double) as c1, least(0.85::double, 0.55::double + score * 0.30::double) as c2 from best join ends using (match_id) where rn = 1 and b_ms - f >= 1800000 and l - a_ms >= 1800000),
ranked as (select *, end_ms - start_ms as long, row_number() over (partition by match_id order by end_ms - start_ms desc, start_ms) as rk, count(*) over (partition by match_id) as n from blocks),
pairs as (select a.match_id, a.start_ms as s1, a.end_ms as e1, b.start_ms as s2, b.end_ms as e2, a.confidence as c1, b.confidence as c2,
  row_number() over (partition by a.match_id order by least(a.long, b.long) / greatest(a.long, b.long)::double + a.confidence + b.confidence desc, a.rk, b.rk) as rn from ranked a join ranked b on a.match_id = b.match_id and a.rk <= 4 and b.rk <= 4 and b.start_ms - a.end_ms >= 60000),
paired as (select match_id, s1, e1, s2, e2, least(0.95::double, c1) as c1, least(0.95::double, c2) as c2 from pairs where rn = 1
  union all select match_id, start_ms, start_ms + long // 2 - 300000, start_ms + long // 2 + 300000, end_ms, 0.45::double, 0.45::double from ranked where n = 1 and long >= 4200000),
sized as (select match_id, least(trunc(d * 0.03::double)::bigint, 600000) as lead, d - least(trunc(d * 0.02::double)::bigint, 300000) as usable, least(900000, trunc(d * 0.10::double)::bigint) as pause from vids),
mid as (select *, lead + (usable - lead) // 2 as m from sized),
plain as (select match_id, lead as s1, greatest(lead, m - pause // 2) as e1, least(usable, m + pause // 2) as s2, usable as e2, 0.2::double as c1, 0.2::double as c2 from mid),
every as (select 0 as rank, 'central_broadcast_break' as method, * from central union all select 1, 'field_blocks', * from paired union all select 2, 'proportional', * from plain),
chosen as (select *, row_number() over (partition by match_id order by rank) as rn from every),
final as (select *, case rank when 2 then 0.2::double else least(c1, c2) * least(1.0::double, case rank when 0 then greatest(0.65::double, (s2 - e1) / 120000.0::double) else greatest(0.35::double, (s2 - e1) / 480000.0::double) end) end as overall from chosen where rn = 1)
select match_id, 1 as number, s1 as start_ms, e1 as end_ms, round(c1, 6) as confidence, round(overall, 4) as overall, rank = 2 or overall < 0.86 as requires_review, method from final
union all select match_id, 2, s2, e2, round(c2, 6), round(overall, 4), rank = 2 or overall < 0.86, method from final"""
)
def period_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(periods.detect_periods(*recordings(spark, sf_dir)))


@query("""
with spans as (select o_orderkey as id, o_orderkey % 1000 as s, o_orderkey % 1000 + (o_custkey % 50) * 777 as e from orders),
steps as (select *, greatest(500.0::double, (e - s) / 8.0::double) as step from spans),
counts as (select *, least(8, ceil((e - s) / step))::int as n from steps),
times as (select id, e, s + trunc(i * step)::bigint as ts_ms from (select *, unnest(range(n)) as i from counts))
select id, count(*) as samples, max(ts_ms) as last_ms, sum(ts_ms)::bigint as total_ms from times where ts_ms < e group by id""")
def sampled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderkey % 1000 as start_ms", "o_orderkey % 1000 + (o_custkey % 50) * 777 as end_ms")
    return clocks.sample_timestamps(spans, 500, 8).groupBy("id").agg(F.count("*").alias("samples"), F.max("ts_ms").alias("last_ms"), F.sum("ts_ms").alias("total_ms"))


@query(BASE + """ select seg, ts_ms from (select seg, ts_ms, row_number() over (partition by seg, floor((ts_ms + 1 - start) / 125.0::double) order by ts_ms) as rn from (select *, min(ts_ms) over (partition by seg) as start from clock)) where rn = 1""")
def decimated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.decimate(fx.frames(spark, sf_dir).select("seg", "ts_ms"), 8)


def halves(rows: DataFrame) -> DataFrame:
    """Both halves of each segment's time; they share the middle, which belongs to the first."""
    ends = rows.groupBy(F.col("seg").alias("match_id")).agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    ends = ends.withColumn("m", F.expr("(a + b) div 2"))
    return ends.selectExpr("match_id", "stack(2, 1, a, m, 0L, 2, m, b - 5000, 2700000L) as (number, start_ms, end_ms, clock_start_ms)")


HALVES = BASE + """,
ends as (select seg, min(ts_ms) as a, max(ts_ms) as b, (min(ts_ms) + max(ts_ms)) // 2 as m from clock group by seg),
halves as (select seg as match_id, 1 as number, a as s, m as e, 0 as c from ends union all select seg, 2, m, b - 5000, 2700000 from ends)"""


@query(HALVES + """, hits as (select t.seg as match_id, t.ts_ms, h.number, h.c + t.ts_ms - h.s as match_ms, row_number() over (partition by t.seg, t.ts_ms order by h.number) as rn from clock t left join halves h on h.match_id = t.seg and t.ts_ms between h.s and h.e)
select match_id, ts_ms, coalesce(number, -1) as period, coalesce(match_ms, -1) as match_ms from hits where rn = 1""")
def match_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frames(spark, sf_dir).selectExpr("seg", "ts_ms")
    return clocks.to_match_time(rows.withColumnRenamed("seg", "match_id"), halves(rows)).select("match_id", "ts_ms", "period", "match_ms").fillna(-1)


@query(HALVES + """, sized as (select *, least(7000, greatest(0, e - s)) as len from halves),
placed as (select match_id, number, unnest([1, 2, 3]) as window_index, unnest([0.18::double, 0.5::double, 0.78::double]) as p, s, len, greatest(0, e - s) - len as free from sized)
select match_id, number, window_index, s + trunc(free * p)::bigint as start_ms, s + trunc(free * p)::bigint + len as end_ms from placed""")
def tracking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.tracking_windows(halves(fx.frames(spark, sf_dir).select("seg", "ts_ms")), "sample", 7, 3)


@query(HALVES + """, sized as (select *, least(7000, greatest(0, e - s)) as len from halves)
select match_id, ceil(sum(e - s) / 1000.0::double * case when match_id % 2 = 0 then 25 else 4.5::double end)::bigint as whole, ceil(sum(3 * len) / 1000.0::double * 8)::bigint as sample from sized group by match_id""")
def frame_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of whole halves at each recording's rate, and of three short windows a half at 8 a second."""
    rows = halves(fx.frames(spark, sf_dir).select("seg", "ts_ms"))
    whole = clocks.tracking_windows(rows).withColumn("fps", F.expr("if(match_id % 2 = 0, 25.0D, 4.5D)"))
    whole = clocks.estimated_frames(whole, F.col("fps")).withColumnRenamed("frames", "whole")
    return whole.join(clocks.estimated_frames(clocks.tracking_windows(rows, "sample", 7, 3), 8.0).withColumnRenamed("frames", "sample"), "match_id")


#: Results at 5 and at 25 frames a second: the tolerance of a run is 105 or 80 ms.
TOLERANCE = "case when c.seg % 2 = 1 then 105 else 80 end"


def with_tolerance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tolerance_ms", clocks.frame_tolerance(F.expr("if(seg % 2 = 1, 5.0D, 25.0D)"), 80))


@query(BASE + f""", outer_frames as (select seg, ts_ms + 37 as r_ms, k from clock where k % 3 = 0),
hits as (select c.seg, c.ts_ms, o.r_ms, o.k, row_number() over (partition by c.seg, c.ts_ms order by abs(o.r_ms - c.ts_ms), o.r_ms desc) as rn from clock c left join outer_frames o on o.seg = c.seg and abs(o.r_ms - c.ts_ms) <= {TOLERANCE})
select seg, ts_ms, coalesce(r_ms, -1) as source_ms, coalesce(k, -1) as source_k from hits where rn = 1""")
def asof_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frames(spark, sf_dir).select("seg", "ts_ms", "k")
    found = clocks.asof_nearest(with_tolerance(rows.select("seg", "ts_ms")), rows.where("k % 3 = 0").withColumn("ts_ms", F.col("ts_ms") + 37), "tolerance_ms")
    return found.select("seg", "ts_ms", F.col("near.ts_ms").alias("source_ms"), F.col("near.k").alias("source_k")).fillna(-1)


FUSED = BASE + f""", near as (select c.seg, c.ts_ms, c.k, o.ts_ms + 37 as r_ms, o.k as r_k, row_number() over (partition by c.seg, c.ts_ms order by abs(o.ts_ms + 37 - c.ts_ms), o.ts_ms desc) as rn from clock c left join clock o on o.seg = c.seg and o.k % 3 = 0 and abs(o.ts_ms + 37 - c.ts_ms) <= {TOLERANCE}),
hits as (select *, k % 17 <> 0 as ball, r_ms is not null as hit, r_ms is not null and r_k % 2 = 1 as other from near where rn = 1)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two sources, whose sizes differ where the external one's number is odd."""
    rows = fx.frames(spark, sf_dir).select("seg", "ts_ms", "k")
    one = lambda role: F.struct(F.lit(role).alias("role"))
    local = rows.withColumn("objects", F.when(F.col("k") % 17 != 0, F.array(one("player"), one("ball"), one("ball"))).otherwise(F.array(one("player")))).drop("k")
    external = rows.where("k % 3 = 0").select("seg", (F.col("ts_ms") + 37).alias("ts_ms"), F.array(one("player"), one("goalkeeper"), one("ball")).alias("objects"), F.expr("if(k % 2 = 1, 1280, 1920)").alias("width"), F.lit(1080).alias("height"))
    return clocks.fuse(with_tolerance(local).withColumn("width", F.lit(1920)).withColumn("height", F.lit(1080)), external, "tolerance_ms")


@query(FUSED + """ select seg, count(*) as frames, count(*) filter (not hit) as missing_frames, count(*) filter (not hit) > 0.05 * count(*) as failed, (sum(case when ball then 1 else 0 end) + 2 * count(*) filter (hit and not other))::bigint as objects from hits group by seg""")
def fused_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.coverage(fused(spark, sf_dir), "seg", 0.05, F.sum(F.size("objects").cast("long")).alias("objects"))


@query(FUSED + " select seg, ts_ms, r_ms as source_ms, 'size' as rule from hits where other")
def fusion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).where("rule is not null").select("seg", "ts_ms", "source_ms", "rule")


@query(BASE + """, runs as (select seg as run_id, count(*) as frames, max(ts_ms) as done_ms, max(seq) * 200 as all_ms, max(seq) * 90 as elapsed_ms from clock group by seg),
r as (select *, least(1.0::double, greatest(0.0::double, done_ms / greatest(1, all_ms)::double)) as ratio from runs)
select run_id, frames, done_ms, round(ratio, 6) as ratio, round(done_ms / greatest(1, elapsed_ms)::double, 6) as speed, round(case when done_ms > 0 then greatest(0, all_ms - done_ms) / (done_ms / greatest(1, elapsed_ms)::double) end, 6) as left_ms, floor(22 + 46 * ratio)::bigint as percent from r""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frames(spark, sf_dir).selectExpr("seg as run_id", "0 as start_ms", "seq * 200 as duration_ms", "ts_ms", "seq * 90 as elapsed_ms")
    return shown(clocks.progress(rows))


@query()
def repaired_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported times that fall back every 11th frame and are missing every 7th."""
    rows = fx.frames(spark, sf_dir).selectExpr("seg", "seq as frame", "case when seq % 7 = 3 then null when seq % 11 = 5 then ts_ms - 900 else ts_ms end as reported_ms", "0L as start_ms", "10.0D as fps")
    return clocks.repair_clock(rows).select("seg", "frame", "ts_ms")
