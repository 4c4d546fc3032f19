"""Column functions: time, scores, ratios, comparisons, reasons and identity texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9
INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def big(c: Column | str) -> Column:
    """An exact integer of up to 38 digits."""
    return col(c).cast("decimal(38,0)")


def floor_div(a: Column, b: Column) -> Column:
    """Exact quotient of non-negative 38-digit integers; ``div`` on decimals would wrap at 64 bits."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def isqrt(v: Column) -> Column:
    """Exact integer square root of a non-negative 38-digit integer."""
    guess = F.floor(F.sqrt(v.cast("double"))).cast("decimal(19,0)")
    low = F.when(guess * guess > v, guess - 1).otherwise(guess).cast("decimal(19,0)")
    up = (low + 1).cast("decimal(19,0)")
    return F.when(up * up <= v, up).otherwise(low).cast("bigint")


def seconds_to_ns(seconds: Column | str) -> Column:
    """Seconds as exact decimal to integer ns, without the loss of a binary fraction."""
    return (col(seconds).cast("decimal(28,9)") * F.lit(1_000_000_000)).cast("bigint")


def ns_text(ns: Column | str) -> Column:
    """Nanoseconds as seconds with nine places; null as N/A."""
    n = col(ns)
    sign, size = F.when(n < 0, "-").otherwise(""), F.abs(n)
    whole = F.floor(size / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("string")
    return F.coalesce(F.concat(sign, whole, F.lit("."), F.lpad((size % 1_000_000_000).cast("string"), 9, "0")), F.lit("N/A"))


def irregularity(count, expected, max_gap_ns, jitter_ns) -> Column:
    """Ten times the missing share, ten times the largest gap and five times the jitter, both in seconds."""
    n, e = col(count).cast("double"), col(expected).cast("double")
    missing = F.when(e > 0, F.greatest(F.lit(0.0), (e - n) / e)).otherwise(0.0)
    return 10 * missing + 10 * (col(max_gap_ns) / 1e9) + 5 * (col(jitter_ns) / 1e9)


def guarded_log_ratio(a: Column, b: Column) -> Column:
    """|ln(a / b)|; 0 if both are about 0, 10 if only one is."""
    az, bz = F.abs(a) <= TINY, F.abs(b) <= TINY
    return F.when(az & bz, 0.0).when(az | bz, 10.0).otherwise(F.abs(F.ln(a / b)))


def baseline_score(count, gap, jitter, base_count, base_gap, base_jitter) -> Column:
    """Distance of a window from its topic's medians; a window without messages adds 10."""
    n = col(count).cast("double")
    body = guarded_log_ratio(n, col(base_count).cast("double")) + guarded_log_ratio(col(gap), col(base_gap)) + guarded_log_ratio(col(jitter), col(base_jitter))
    return body + F.when(n == 0, 10.0).otherwise(0.0)


def ratio(incident, normal) -> Column:
    n = col(normal)
    return F.when(F.abs(n) > TINY, col(incident) / n)


def ratio_text(r: Column | str) -> Column:
    return F.when(col(r).isNull(), "N/A").otherwise(F.format_string("%.3fx", col(r)))


def highlighted(r: Column | str, incident_count, threshold: float = 1.5) -> Column:
    """Changed by the threshold either way, or gone."""
    return F.coalesce((col(r) >= threshold) | (col(r) <= 1 / threshold), F.lit(False)) | (col(incident_count) == 0)


def deviation(incident_count, *ratios: Column | str) -> Column:
    """Largest |ln ratio|; infinite if the incident has no message; null and zero ratios are passed over."""
    parts = [F.when(col(r) > 0, F.abs(F.ln(col(r)))).otherwise(0.0) for r in ratios]
    return F.when(col(incident_count) == 0, F.lit(INF)).otherwise(F.greatest(*parts))


def deviation_reason(normal_count, incident_count, threshold: float = 1.5, **ratios) -> Column:
    """Why a topic stands out: its ratio farthest from 1, by name if they tie; a zero ratio is farthest of all."""
    rows = F.array(*[F.struct(F.when(col(r) == 0, F.lit(INF)).otherwise(F.abs(F.ln(F.when(col(r) > 0, col(r))))).alias("distance"), F.lit(name).alias("name"), col(r).alias("value")) for name, r in ratios.items()])
    outside = F.filter(rows, lambda x: x["value"].isNotNull() & ((x["value"] >= threshold) | (x["value"] <= 1 / threshold)))
    top = F.array_max(outside)
    return F.when((col(normal_count) > 0) & (col(incident_count) == 0), "incident_missing").when(F.size(outside) == 0, "within_threshold").otherwise(F.concat(top["name"], F.format_string("_ratio=%.3fx", top["value"])))


def confidence(normal_count, incident_count, least: int = 5) -> Column:
    n, i = col(normal_count), col(incident_count)
    return F.when((n == 0) & (i == 0), "none").when(F.least(n, i) < least, "low").otherwise("normal")


def rate_score(incident_hz, normal_hz) -> Column:
    i, n = col(incident_hz), col(normal_hz)
    iz, nz = F.abs(i) <= TINY, F.abs(n) <= TINY
    return F.when(iz & nz, 0.0).when(iz | nz, F.lit(INF)).otherwise(F.abs(F.ln(i / n)))


def safe_ratio(incident_hz, normal_hz) -> Column:
    i, n = col(incident_hz), col(normal_hz)
    return F.when(F.abs(n) > TINY, i / n).when(F.abs(i) > TINY, F.lit(INF))


def rate_reason(topic, incident_hz, normal_hz, control_topics=("/cmd_vel",), threshold: float = 1.5) -> Column:
    i, n = col(incident_hz), col(normal_hz)
    r = safe_ratio(i, n)
    return (
        F.when((n <= TINY) & (i > TINY), "normal_missing_incident_present").when((n > TINY) & (i <= TINY), "normal_present_incident_missing")
        .when(col(topic).isin(list(control_topics)) & (r >= threshold), "control_context_shift")
        .otherwise("rate_ratio")
    )


def numeric_change(reference, target) -> Column:
    """struct(delta, ratio, ratio_state) of two numbers: finite, both_zero (ratio 1) or reference_zero (no ratio)."""
    r, t = col(reference).cast("double"), col(target).cast("double")
    state = F.when(r.isNull() | t.isNull(), None).when((r == 0) & (t == 0), "both_zero").when(r == 0, "reference_zero").otherwise("finite")
    quotient = F.when((r == 0) & (t == 0), 1.0).when(r != 0, t / F.when(r != 0, r))
    return F.struct((t - r).alias("delta"), quotient.alias("ratio"), state.alias("ratio_state"))


def iso_time(text: Column | str) -> Column:
    """ISO-8601 text that carries an offset, as a timestamp; null for anything else."""
    t = col(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))


def canonical_map(dims: Column | str, most: int = 64, longest: int = 256) -> Column:
    """A dimension map with trimmed keys and values in key order; null if it breaks a limit or keys collide."""
    entries = F.transform(F.map_entries(col(dims)), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    good = (F.size(entries) <= most) & F.forall(entries, lambda e: e["value"].isNotNull() & (F.length(e["key"]) > 0) & (F.length(e["key"]) <= longest) & (F.length(e["value"]) > 0) & (F.length(e["value"]) <= longest)) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(good, F.map_from_entries(F.sort_array(entries)))


def json_text(value: Column) -> Column:
    """A JSON string literal, all beyond ASCII escaped."""
    quoted = F.to_json(F.struct(value.alias("v")))
    inner = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    chars = F.transform(F.split(inner, ""), lambda c: F.when((F.length(c) == 1) & (F.ascii(c) > 126), _escaped(c)).otherwise(c))
    return F.when(inner.rlike(r"[^\x20-\x7e]"), F.array_join(chars, "")).otherwise(inner)


def _escaped(c: Column) -> Column:
    """UTF-16 escapes of one character."""
    code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 16)
    return F.when(F.length(F.encode(c, "UTF-16BE")) == 2, F.concat(F.lit("\\u"), F.lower(F.lpad(code, 4, "0")))).otherwise(
        F.concat(F.lit("\\u"), F.lower(F.substring(F.hex(F.encode(c, "UTF-16BE")), 1, 4)), F.lit("\\u"), F.lower(F.substring(F.hex(F.encode(c, "UTF-16BE")), 5, 4)))
    )


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no blanks; values are JSON texts already."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def detail_text(event_type, summary) -> Column:
    """A line on what an event says, by its type; ``summary`` is a map of texts."""
    say = lambda *parts: F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(col(summary)[p], F.lit("None")) for k, p in enumerate(parts)])
    return (
        F.when(col(event_type) == "COMMAND_SUMMARY", say("cmd linear_x=", "linear_x", " angular_z=", "angular_z", " type=", "message_type"))
        .when(col(event_type) == "MOTION_SUMMARY", say("motion vx=", "linear_velocity_x", " wz=", "angular_velocity_z"))
        .when(col(event_type) == "PERCEPTION_SUMMARY", say("scan min_range=", "min_range", " valid=", "valid_range_count", " invalid=", "invalid_range_count"))
        .otherwise(F.to_json(col(summary)))
    )


def count_ratio(count, expected) -> Column:
    return F.when(col(expected) > 0, col(count) / col(expected))
