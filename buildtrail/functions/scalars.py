"""Column functions: keys, names, sizes, times, logs. Bad text gives NULL, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of nodes, phases, size ladder (name, millicpu, GiB).
KINDS = ("import", "buildfrom", "pluginresolve", "pin", "buildrun", "buildvalue")
CHAIN = ("buildfrom", "pluginresolve", "pin", "buildrun")
STAGES = {"buildfrom": "eval", "pluginresolve": "resolve", "pin": "pin", "buildrun": "build", "import": "fetch"}
ACTIVE = ("queued", "running", "publishing")
TERMINAL = ("done", "failed", "failed-upstream", "cancelled")
PHASE_ORDER = ("failed", "failed-upstream", "running", "publishing", "queued", "waiting", "cancelled", "done")
LADDER = (("c0.2-m1", 200, 1), ("c1-m1", 1000, 1), ("c1-m2", 1000, 2), ("c1-m4", 1000, 4), ("c2-m4", 2000, 4), ("c2-m8", 2000, 8), ("c2-m16", 2000, 16), ("c4-m8", 4000, 8), ("c4-m16", 4000, 16))
MEMORY_UNITS = (("Ki", 1 << 10), ("Mi", 1 << 20), ("Gi", 1 << 30), ("Ti", 1 << 40), ("K", 10**3), ("M", 10**6), ("G", 10**9), ("T", 10**12))
GIB, MIB = 1 << 30, 1 << 20


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_canonical_hex_key(c: Column | str) -> Column:
    return col(c).rlike("^[0-9a-f]{64}$")


def parse_node(c: Column | str) -> Column:
    """{kind, key} of ``<kind>_<64 hex>``, NULL for anything else."""
    found = F.regexp_extract(col(c), "^(" + "|".join(KINDS) + ")_([0-9a-f]{64})$", 1)
    return F.when(found != "", F.struct(found.alias("kind"), F.substring_index(col(c), "_", -1).alias("key")))


def is_active(phase: Column | str) -> Column:
    return col(phase).isin(*ACTIVE)


def is_terminal(phase: Column | str) -> Column:
    return col(phase).isin(*TERMINAL)


def phase_rank(phase: Column | str) -> Column:
    """Place of a phase when problems come first; unknown phases after all known ones."""
    pairs = [(F.lit(p), F.lit(i)) for i, p in enumerate(PHASE_ORDER)]
    return reduce(lambda out, x: F.when(col(phase) == x[0], x[1]).otherwise(out), reversed(pairs), F.lit(len(pairs)))


def valid_dep_name(c: Column | str) -> Column:
    """Not empty, at most 128 bytes, no separators or control characters, not . or .."""
    return (F.octet_length(col(c)).between(1, 128)) & ~col(c).rlike(r"[/\\\x00-\x1f\x7f]") & ~col(c).isin(".", "..")


def parse_cpu(c: Column | str) -> Column:
    """Millicpu of "200m", "0.2", "2"."""
    t = F.trim(col(c))
    milli = F.regexp_extract(t, r"^([+-]?\d+)m$", 1)
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.round(t.try_cast("double") * 1000).cast("long"))
    return F.when(milli != "", milli.try_cast("long")).otherwise(plain)


def parse_mem(c: Column | str) -> Column:
    """Bytes of "512Mi", "1G" or a bare count."""
    t = F.trim(col(c))
    number, unit = F.regexp_extract(t, r"^([+-]?\d+)\s*([KMGT]i?)?$", 1), F.regexp_extract(t, r"^([+-]?\d+)\s*([KMGT]i?)?$", 2)
    by = reduce(lambda out, x: F.when(unit == x[0], F.lit(x[1])).otherwise(out), MEMORY_UNITS, F.lit(1))
    return F.when(number != "", F.try_multiply(number.try_cast("long"), by))


def human_bytes(c: Column | str, most: str = "E") -> Column:
    """Binary units with one decimal, the largest of which is that of the letter ``most``."""
    n = col(c).cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, letter in enumerate("KMGTPE"[: "KMGTPE".index(most) + 1], 1):
        out = F.when(n >= 1 << (10 * power), F.concat(F.format_string("%.1f", F.bround(n / float(1 << (10 * power)), 1)), F.lit(f" {letter}iB"))).otherwise(out)
    return out


def human_age(seconds: Column | str) -> Column:
    """The two leading units; negative spans are 0s."""
    s = F.greatest(F.floor(col(seconds)).cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day, hour, minute = F.floor(s / 86400), F.floor(s / 3600), F.floor(s / 60)
    long = F.concat(day.cast("string"), F.lit("d"), two(hour % 24), F.lit("h"))
    out = F.when(s < 86400, F.concat(hour.cast("string"), F.lit("h"), two(minute % 60), F.lit("m"))).otherwise(long)
    out = F.when(s < 3600, F.concat(minute.cast("string"), F.lit("m"), two(s % 60), F.lit("s"))).otherwise(out)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(out)


def short_key(c: Column | str) -> Column:
    return F.substring(col(c), 1, 12)


def short_node(c: Column | str) -> Column:
    """kind:first 8 hex digits of the key; other names stay."""
    return F.when(col(c).contains("_"), F.concat_ws(":", F.substring_index(col(c), "_", 1), F.substring(F.substring_index(col(c), "_", -1), 1, 8))).otherwise(col(c))


def cache_ref(cache_id: Column | str, platform: Column | str) -> Column:
    return F.concat(F.lit("build-cache:"), col(cache_id), F.lit(":"), col(platform))


def parse_cache_ref(c: Column | str) -> Column:
    """{id, platform} of a cache ref, NULL for other names."""
    pattern = r"^build-cache:([A-Za-z0-9][A-Za-z0-9._-]{0,127}):(.+)$"
    return F.when(col(c).rlike(pattern), F.struct(F.regexp_extract(col(c), pattern, 1).alias("id"), F.regexp_extract(col(c), pattern, 2).alias("platform")))


def clean_path(c: Column | str) -> Column:
    """The shortest equal path, by elements: no empty or "." element, ".." takes one off."""
    parts = F.filter(F.split(col(c), "/"), lambda x: ~x.isin("", "."))
    rooted = col(c).startswith("/")
    step = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when((x == "..") & rooted, a).otherwise(F.concat(a, F.array(x)))
    body = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def strip_components(c: Column | str, n: int) -> Column:
    """Path less its first n elements, NULL if none is left."""
    parts = F.filter(F.split(col(c), "/"), lambda x: x != "")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, n + 1, F.size(parts)), "/"))


def http_failure_class(status: Column | str, rate_left: Column | str) -> Column:
    s = col(status)
    return F.when(s.between(200, 299), F.lit("ok")).when((s == 429) | (s >= 500) | ((s == 403) & (F.coalesce(col(rate_left), F.lit("")) == "0")), F.lit("retryable")).otherwise(F.lit("hard"))


def stage_name(kind: Column | str) -> Column:
    """The display name of a kind's stage, NULL for kinds without one."""
    return reduce(lambda out, x: F.when(col(kind) == x[0], F.lit(x[1])).otherwise(out), STAGES.items(), F.lit(None).cast("string"))


def ns_to_ts(ns: Column | str) -> Column:
    return F.timestamp_micros(F.floor(col(ns) / 1000).cast("long"))


def usable_capacity(cpu: Column | str, mem: Column | str, least_cpu: int = 1000, least_mem: int = 2 * GIB) -> Column:
    """{cpu, mem} less a reserve (500m or 512 MiB, or 10 % if more), one default build at least."""
    keep = lambda x, reserve, least: F.greatest(x - F.greatest(F.lit(reserve), F.floor(x * 10 / 100).cast("long")), F.lit(least))
    return F.struct(keep(col(cpu), 500, least_cpu).alias("cpu"), keep(col(mem), 512 * MIB, least_mem).alias("mem"))


def trim_tail_first(head: Column | str, gap: Column | str, tail: Column | str, budget: int) -> Column:
    """{head, gap, tail, truncated}: binary head and tail cut to budget bytes in sum; the tail's end has priority."""
    h, g, t = col(head), col(gap), col(tail)
    over = F.octet_length(h) + F.octet_length(t) > budget
    keep_t = F.least(F.octet_length(t), F.lit(budget))
    keep_h = F.least(F.octet_length(h), budget - keep_t)
    cut = F.octet_length(h) - keep_h + F.octet_length(t) - keep_t
    new_t = t.substr(F.octet_length(t) - keep_t + 1, keep_t)
    return F.when(over, F.struct(h.substr(F.lit(1), keep_h).alias("head"), (g + cut).alias("gap"), new_t.alias("tail"), F.lit(True).alias("truncated"))).otherwise(F.struct(h.alias("head"), g.alias("gap"), t.alias("tail"), F.lit(False).alias("truncated")))


def canonical_list(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col(c)))


def definition_key(*fields: str) -> Column:
    """Digest of the named fields' JSON in name order; NULL fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def backoff_ms(consecutive: Column | str, base_ms: int = 1000) -> Column:
    """base 2^(n-1), 30 times base at most."""
    return F.least(F.lit(30 * base_ms), (F.lit(base_ms) * F.pow(F.lit(2.0), col(consecutive) - 1))).cast("long")


def key_type(key: Column | str) -> Column:
    """The type in the upper four bits of a hex key's first byte."""
    return F.conv(F.substring(col(key), 1, 1), 16, 10).cast("int")


def key_length(key: Column | str) -> Column:
    """The logical length: as many bytes as the lower four bits of the first byte say, big-endian."""
    n = F.conv(F.substring(col(key), 2, 1), 16, 10).cast("int")
    return F.when(n <= 7, F.coalesce(F.conv(F.when(n > 0, col(key).substr(F.lit(3), 2 * n)).otherwise(F.lit("0")), 16, 10).cast("long"), F.lit(0)))


def event_field(data: Column | str, name: str, kind: str) -> Column:
    """A typed field of an event's JSON; NULL where it is absent or of another type."""
    return F.get_json_object(col(data), f"$.{name}").try_cast(kind)


def attempt_verdict(cls: Column | str, disposition: Column | str, exit_code: Column | str) -> Column:
    """Class, disposition and a non-zero exit code as one line."""
    return F.concat_ws(" ", col(cls), F.when(col(disposition) != "done", F.concat(F.lit("("), col(disposition), F.lit(")"))), F.when(col(exit_code) != 0, F.concat(F.lit("exit "), col(exit_code).cast("string"))))


def label_node(label: Column | str, node: Column | str) -> Column:
    """The label where there is one, with the short node name."""
    return F.concat_ws(" ", F.when(F.coalesce(col(label), F.lit("")) != "", col(label)), F.concat(F.lit("["), short_node(node), F.lit("]")))


def result_class(outcome: Column | str) -> Column:
    """Class of an outcome word; unknown words are hard."""
    return F.when(col(outcome).isin("ok", "done"), F.lit("ok")).when(col(outcome).isin("timeout", "lost", "busy"), F.lit("retryable")).when(col(outcome) == "cancelled", F.lit("cancelled")).when(col(outcome) == "draining", F.lit("control")).otherwise(F.lit("hard"))


def format_bytes(c: Column | str, most: str = "E") -> Column:
    """Decimal units with one decimal, the largest of which is that of the letter ``most``."""
    n = col(c).cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, letter in enumerate("kMGTPE"[: "kMGTPE".index(most) + 1], 1):
        unit = 10 ** (3 * power)
        out = F.when(n >= unit, F.concat(F.format_string("%.1f", F.bround(n / float(unit), 1)), F.lit(f" {letter}B"))).otherwise(out)
    return out


def ns_to_rfc3339(ns: Column | str) -> Column:
    """UTC text with nanoseconds, trailing zeros left out. Whole numbers beyond a long are given as decimals."""
    n = col(ns).cast("decimal(38,0)")
    part = F.pmod(n, F.lit(10**9).cast("decimal(38,0)")).cast("long")
    rest = F.regexp_replace(F.lpad(part.cast("string"), 9, "0"), "0+$", "")
    seconds = ((n - part) / F.lit(10**9).cast("decimal(10,0)")).cast("long")
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("Z"))


def trim_snapshot(head: Column | str, gap: Column | str, tail: Column | str, head_cap: int, tail_cap: int) -> Column:
    """{head, gap, tail}: the head's first and the tail's last bytes; what is cut goes to the gap."""
    h, t = col(head), col(tail)
    keep_h, keep_t = F.least(F.octet_length(h), F.lit(head_cap)), F.least(F.octet_length(t), F.lit(tail_cap))
    cut = F.octet_length(h) - keep_h + F.octet_length(t) - keep_t
    return F.struct(h.substr(F.lit(1), keep_h).alias("head"), (col(gap) + cut).alias("gap"), t.substr(F.octet_length(t) - keep_t + 1, keep_t).alias("tail"))


def valid_utf8(data: Column | str) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(col(data).cast("string"))


def assemble_log(head: Column | str, gap: Column | str, tail: Column | str) -> Column:
    """One text; a line says how many bytes are left out, where any are."""
    line = F.when(col(gap) > 0, F.concat(F.lit("\n[... "), col(gap).cast("string"), F.lit(" bytes omitted ...]\n"))).otherwise("")
    return F.concat(valid_utf8(head), line, valid_utf8(tail))


def attempt_timing_text(queued_s: Column | str, ran_s: Column | str) -> Column:
    """"queued 3s, ran 1m05s", with what is known."""
    part = lambda word, c: F.when(col(c).isNotNull(), F.concat(F.lit(word + " "), human_age(c)))
    return F.concat_ws(", ", part("queued", queued_s), part("ran", ran_s))


def rusage_text(cpu_s: Column | str, rss: Column | str) -> Column:
    """"cpu 3s, rss 1.0 MiB", with what is above 0."""
    return F.concat_ws(", ", F.when(col(cpu_s) > 0, F.concat(F.lit("cpu "), human_age(cpu_s))), F.when(col(rss) > 0, F.concat(F.lit("rss "), human_bytes(rss))))


def finish_outcome(cls: Column | str) -> Column:
    """What a finish event says of a result's class."""
    return F.when(col(cls) == "ok", "ok").when(col(cls) == "cancelled", "cancelled").otherwise("failed")


def requests_of(data: Column | str) -> Column:
    """The request ids of an event's JSON, none if it has no list of them."""
    return F.coalesce(F.from_json(F.get_json_object(col(data), "$.requests"), "array<string>"), F.array().cast("array<string>"))


def canonical_by_name(items: Column | str) -> Column:
    """Structs with a field name, the first of each name, in order of name."""
    x = col(items)
    first = F.filter(x, lambda a, i: ~F.exists(F.slice(x, 1, i), lambda b: b["name"] == a["name"]))
    return F.array_sort(first, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))


def normalize_source_path(path: Column | str, directory: Column | str) -> Column:
    """A source path under the root: "//x" is from the root, others from directory; NULL for absolute ones, the root and what escapes it."""
    p = col(path)
    joined = F.when(p.startswith("//"), F.substring(p, 3, 1 << 20)).otherwise(F.concat(col(directory), F.lit("/"), p))
    clean = clean_path(F.regexp_replace(joined, "^/+", ""))
    bad = (p.startswith("/") & ~p.startswith("//")) | (clean == ".") | (clean == "..") | clean.startswith("../")
    return F.when(~bad, clean)


def kp_tree_ref(key: Column | str) -> Column:
    return F.concat(F.lit("kp-tree/"), col(key))


def f_tree_ref(key: Column | str) -> Column:
    return F.concat(F.lit("f-tree/"), col(key))


def pin_cover_ref(key: Column | str, version: int = 2) -> Column:
    """The name that binds a key to its cover under a version of the closure's rules."""
    return F.concat(F.lit(f"pin-cover/{version}:"), col(key))


def parse_pin_cover_ref(c: Column | str) -> Column:
    """{version, key} of such a name, NULL for other texts."""
    pattern = r"^pin-cover/(\d+):(.+)$"
    part = lambda i: F.regexp_extract(col(c), pattern, i)
    return F.when(col(c).rlike(pattern), F.struct(part(1).cast("int").alias("version"), part(2).alias("key")))


def platform_token(platform: Column | str) -> Column:
    return F.replace(col(platform), F.lit("/"), F.lit("-"))


def jobs_subject(platform: Column | str, rung: Column | str) -> Column:
    """The subject of the queue of one platform and rung."""
    return F.concat(F.lit("jobs."), platform_token(platform), F.lit("."), col(rung))


def node_subject(root: str, node: Column | str) -> Column:
    """The subject of a node's results, failures or logs."""
    return F.concat(F.lit(f"{root}."), col(node))


def heartbeat_subject(runner: Column | str) -> Column:
    return F.concat(F.lit("runners."), col(runner), F.lit(".hb"))


def lane_name(platform: Column | str, rung: Column | str) -> Column:
    """The name under which all runners of a platform and rung take work: dots would part a name, so they become underscores."""
    return F.concat(F.lit("wq-"), platform_token(platform), F.lit("-"), F.replace(col(rung), F.lit("."), F.lit("_")))


def message_id(kind: str, node: Column | str, gen: Column | str) -> Column:
    """The id by which replays of a job or result are known: job-<node>-<gen>."""
    return F.concat(F.lit(f"{kind}-"), col(node), F.lit("-"), col(gen).cast("string"))


def parse_message_id(c: Column | str) -> Column:
    """{kind, node, gen} of a message id, NULL for other texts."""
    pattern = r"^(job|result|failure)-(.+)-(\d+)$"
    part = lambda i: F.regexp_extract(col(c), pattern, i)
    return F.when(col(c).rlike(pattern), F.struct(part(1).alias("kind"), part(2).alias("node"), part(3).cast("long").alias("gen")))
