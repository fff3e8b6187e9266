"""Scalar functions of event normalization, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that inputs use.
RELATION_ALIASES = {"spawned_by": "spawn", "acts_on": "write", "modifies": "write", "connects_to": "connect", "resolves": "resolve", "requests": "request", "invoked_by": "invoke"}
SEVERITY_POINTS = {"low": 2.0, "medium": 6.0, "high": 8.0, "critical": 10.0}
TRUE_WORDS = ("1", "true", "yes", "y", "on")
BYTE_FIELDS = ("bytes", "size", "len", "nbytes", "byte_count", "total_bytes", "transfer_bytes", "sent_bytes", "recv_bytes", "write_bytes", "read_bytes")


def normalize_text(c: Column) -> Column:
    """Lower case without outer blanks; null is empty."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def truthy(c: Column) -> Column:
    """A word of yes, or a number that isn't zero."""
    n = F.trim(c.cast("string")).try_cast("double")
    return normalize_text(c).isin(*TRUE_WORDS) | F.coalesce(n != 0, F.lit(False))


def to_nonneg_int(c: Column) -> Column:
    """A number's whole part if it isn't negative; null for anything else, booleans included."""
    number = F.trim(c.cast("string")).try_cast("double")
    whole = F.when(number > -1, F.when(number >= 0, F.floor(number)).otherwise(F.lit(0))).cast("double")
    return whole.try_cast("bigint")


def extract_bytes(fields: dict[str, Column], others: tuple[str, ...] | list[str] = BYTE_FIELDS) -> Column:
    """Sent plus received, else written plus read, else the first other field that holds a count."""
    get = lambda k: to_nonneg_int(fields[k]) if k in fields else F.lit(None).cast("bigint")
    return F.coalesce(get("sent_bytes") + get("recv_bytes"), get("write_bytes") + get("read_bytes"), *[get(k) for k in others])


def parse_ts(c: Column) -> Column:
    """A timestamp: numbers count seconds, milli-, micro- or nanoseconds by their size, other text is ISO 8601; null if neither."""
    text = F.trim(c.cast("string"))
    n = text.try_cast("double")
    size = F.abs(n)
    seconds = F.when(size >= 1e17, n / 1e9).when(size >= 1e14, n / 1e6).when(size >= 1e11, n / 1e3).otherwise(n)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")), F.try_to_timestamp(text))


def canonical_relation(c: Column) -> Column:
    name = normalize_text(c)
    return reduce(lambda acc, kv: acc.when(name == kv[0], kv[1]), RELATION_ALIASES.items(), F.when(F.lit(False), F.lit(""))).otherwise(name)


def basename(c: Column) -> Column:
    """Last part of a path with either slash, without quotes around it, in lower case; empty if there is none."""
    text = F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), "^[\"']+|[\"']+$", "")
    flat = F.translate(text, "\\", "/")
    parts = F.filter(F.split(flat, "/"), lambda x: x != "")
    return F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), flat))


def first_text(*columns: Column) -> Column:
    """The first column that holds text."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def process_name(named: list[Column], command_lines: list[Column], images: list[Column]) -> Column:
    """Basename of the first field with one: named fields, then a command line's first word, then images."""
    words = [F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(1)) for c in command_lines]
    return F.coalesce(*[F.nullif(basename(c), F.lit("")) for c in [*named, *words, *images]], F.lit(""))


def entity_prefix(c: Column) -> Column:
    return F.lower(F.substring_index(c, ":", 1))


def entity_payload(c: Column) -> Column:
    """What follows the first colon; the whole without one."""
    at = F.locate(":", c)
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c)


def entity(prefix: str, value: Column) -> Column:
    """prefix:value, once."""
    v = F.trim(value)
    return F.when(v == "", F.lit(None)).when(F.startswith(F.lower(v), F.lit(f"{prefix}:")), v).otherwise(F.concat(F.lit(f"{prefix}:"), v))


def entity_type(c: Column) -> Column:
    """Prefixes proc and reg stand for process and registry; others for themselves."""
    p = entity_prefix(c)
    return F.when(p == "proc", "process").when(p == "reg", "registry").otherwise(p)


def windash(c: Column) -> Column:
    """Slashes and long dashes become hyphens."""
    return F.translate(c, "/–—", "---")


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.split(F.trim(c), pattern), lambda x: x != "")


def file_shape(c: Column) -> Column:
    parts = _parts(c, "[/\\\\]")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    ext = F.lower(F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1))
    level = F.greatest(F.size(parts) - 1, F.lit(0))
    top = F.when(F.size(parts) > 1, F.lower(parts[0])).otherwise("(root)")
    return F.concat(F.lit("ext="), F.when(ext == "", "(none)").otherwise(ext), F.lit(";dir_level="), level, F.lit(";topdir="), top)


def _ip6_net(value: Column) -> Column:
    """The /64 of an IPv6 address in its shortest form; null for anything else."""
    halves = F.split(value, "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    head, tail = groups(halves[0]), F.coalesce(groups(F.try_element_at(halves, F.lit(2))), F.array().cast("array<string>"))
    known = F.size(head) + F.size(tail)
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0)))
    whole = F.when(F.size(halves) == 1, head).otherwise(F.concat(head, zeros, tail))
    plain = F.transform(F.slice(whole, 1, 4), lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", "")))
    shown = F.regexp_replace(F.array_join(plain, ":"), "(^|:)0(:0)*$", "")
    net = F.concat(shown, F.lit("::/64"))
    fits = F.regexp_like(value, F.lit("^[0-9A-Fa-f:]+$")) & (F.size(halves) <= 2) & (F.size(whole) == 8) & F.forall(whole, lambda g: F.length(g) <= 4) & ((F.size(halves) == 2) | (known == 8)) & ~F.contains(value, F.lit(":::"))
    return F.when(F.coalesce(fits & ((F.size(halves) == 1) | (known < 8)), F.lit(False)), net)


def ip_shape(c: Column) -> Column:
    """The /24 of an IPv4 address with or without a port, the /64 of an IPv6 address, else invalid."""
    value = F.regexp_replace(F.trim(c), r"^([0-9.]+):[0-9]+$", "$1")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    ok = F.regexp_like(value, F.lit(rf"^{octet}(\.{octet}){{3}}$"))
    return F.concat(F.lit("subnet="), F.coalesce(F.when(ok, F.concat(F.substring_index(value, ".", 3), F.lit(".0/24"))), _ip6_net(value), F.lit("invalid")))


def registry_shape(c: Column) -> Column:
    parts = _parts(c, "[/\\\\]")
    hive = F.coalesce(F.upper(F.try_element_at(parts, F.lit(1))), F.lit("UNKNOWN"))
    keys = F.array_join(F.transform(F.slice(parts, 2, 2), F.lower), "\\")
    return F.concat(F.lit("hive="), hive, F.lit(";key="), F.when(keys == "", "(root)").otherwise(keys))


def entity_shape(c: Column) -> Column:
    """Shape of an entity by its type."""
    kind, value = entity_prefix(c), entity_payload(c)
    return (
        F.when(kind == "file", file_shape(value))
        .when(kind == "ip", ip_shape(value))
        .when(kind.isin("reg", "registry"), registry_shape(value))
        .when(kind.isin("proc", "process"), F.concat(F.lit("name="), F.trim(value)))
        .otherwise(F.concat(F.lit("len="), F.length(F.trim(value))))
    )


def stage_severity(c: Column) -> Column:
    """2, 6, 8 or 10 points for a label or a number; null is 2."""
    label, n = normalize_text(c), c.cast("string").try_cast("double")
    named = reduce(lambda acc, kv: acc.when(label == kv[0], kv[1]), SEVERITY_POINTS.items(), F.when(F.lit(False), F.lit(0.0)))
    return F.coalesce(named, F.when(n < 4, 2.0).when(n < 7, 6.0).when(n < 9, 8.0).when(n >= 9, 10.0), F.lit(2.0))


def cvss(c: Column) -> Column:
    """A label's points or the number itself; null and unknown labels are 0."""
    label = normalize_text(c)
    named = reduce(lambda acc, kv: acc.when(label == kv[0], kv[1]), SEVERITY_POINTS.items(), F.when(F.lit(False), F.lit(0.0)))
    return F.coalesce(named, c.cast("string").try_cast("double"), F.lit(0.0))


def field_values(value: Column, path: str) -> Column:
    """Strings under a path of a JSON text: ``a.b`` steps into objects, ``a{}`` into all entries of an array; lists and objects are flattened."""
    at = "$" + "".join(f"[{part[:-2]!r}][*]" if part.endswith("{}") else f"[{part!r}]" for part in path.split("."))
    got = F.get_json_object(value, at)
    return strings_of(got)


def strings_of(text: Column) -> Column:
    """The scalars of a JSON text as an array of strings, whatever its nesting; plain text is itself."""
    nested = F.regexp_like(text, F.lit(r"^\s*[\[{]"))
    pieces = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', ""), F.lit(r'"((?:[^"\\]|\\.)*)"|(-?[0-9][0-9.eE+-]*|true|false)'), F.lit(0))
    clean = F.transform(pieces, lambda x: F.when(F.startswith(x, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")).otherwise(x))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(nested, clean).otherwise(F.array(text))


def attenuation(distance: Column) -> Column:
    return F.lit(1.0) / (1 + F.greatest(F.lit(0), distance))


def path_factor_passes(pf: Column, threshold: Column, op: str = "le") -> Column:
    """Whether a path factor meets a threshold; unknown and non-positive ones don't."""
    meets = pf <= threshold if op == "le" else pf >= threshold
    return F.coalesce((pf > 0) & meets, F.lit(False))
