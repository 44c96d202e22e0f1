"""Byte-exact and geometric building blocks as SQL text, for Spark and for the DuckDB oracle.

Hashes are lower-case hex strings; numbers enter hashes as big-endian hex of fixed
width, so that sha-256 over them agrees byte for byte with packed binary records.
"""

from __future__ import annotations


class Spark:
    epoch = staticmethod(lambda x: f"unix_timestamp({x})")
    idiv = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    ratio = staticmethod(lambda a, b: f"({a}) / nullif(CAST({b} AS DOUBLE), 0e0)")  # ANSI mode fails on 0, in rows too that another condition drops
    u16 = staticmethod(lambda x: f"lpad(hex(cast({x} as bigint)), 4, '0')")
    u32 = staticmethod(lambda x: f"lpad(hex(cast({x} as bigint)), 8, '0')")
    u64 = staticmethod(lambda x: f"lpad(hex(cast({x} as bigint)), 16, '0')")
    f64 = staticmethod(lambda x: f"lpad(hex(cast(reflect('java.lang.Double', 'doubleToRawLongBits', {x}) as bigint)), 16, '0')")
    little = staticmethod(lambda x: f"regexp_replace(reverse({x}), '(.)(.)', '$2$1')")
    sha = staticmethod(lambda *xs: f"sha2(unhex(concat({', '.join(xs)})), 256)")
    text_hex = staticmethod(lambda x: "'" + x.encode().hex() + "'")
    ordered = staticmethod(lambda x, order: f"array_join(transform(array_sort(collect_list(struct({order} as o, {x} as x))), s -> s.x), '')")
    series = staticmethod(lambda a, b: f"explode(sequence({a}, {b}))")
    pow2 = staticmethod(lambda x: f"shiftleft(1L, cast({x} as int))")
    shift = staticmethod(lambda x, n: f"shiftright({x}, cast({n} as int))")
    bits = staticmethod(lambda x: f"cast(bit_count({x}) as bigint)")
    tables = staticmethod(lambda name: "{" + name + "}")


class Duck:
    epoch = staticmethod(lambda x: f"CAST(floor(epoch({x})) AS BIGINT)")
    idiv = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    ratio = staticmethod(lambda a, b: f"({a}) / CAST({b} AS DOUBLE)")
    u16 = staticmethod(lambda x: f"printf('%04X', CAST({x} AS BIGINT))")
    u32 = staticmethod(lambda x: f"printf('%08X', CAST({x} AS BIGINT))")
    u64 = staticmethod(lambda x: f"printf('%016X', CAST({x} AS BIGINT))")
    f64 = staticmethod(lambda x: f"hex(CAST(CAST({x} AS BIT) AS BLOB))")
    little = staticmethod(lambda x: f"regexp_replace(reverse({x}), '(.)(.)', '\\2\\1', 'g')")
    sha = staticmethod(lambda *xs: f"sha256(unhex({' || '.join(xs)}))")
    text_hex = staticmethod(lambda x: "'" + x.encode().hex() + "'")
    ordered = staticmethod(lambda x, order: f"string_agg({x}, '' ORDER BY {order})")
    series = staticmethod(lambda a, b: f"unnest(range({a}, {b} + 1))")
    pow2 = staticmethod(lambda x: f"(1::BIGINT << CAST({x} AS INTEGER))")
    shift = staticmethod(lambda x, n: f"({x} >> CAST({n} AS INTEGER))")
    bits = staticmethod(lambda x: f"CAST(bit_count({x}) AS BIGINT)")
    tables = staticmethod(lambda name: name)


def overlaps(start: str, end: str, low: str, high: str) -> str:
    """Closed intervals meet."""
    return f"({end} >= {low} AND {start} <= {high})"


def segment_hits(x0: str, y0: str, x1: str, y1: str, w: str) -> str:
    """A segment meets the closed rectangle w (min_lon, min_lat, max_lon, max_lat); clipping without branches."""

    def clip(p: str, q: str, low: str, high: str) -> tuple[str, str, str]:
        d = f"({q} - {p})"
        flat = f"{d} = 0e0"
        a, b = f"(({low} - {p}) / nullif({d}, 0e0))", f"(({high} - {p}) / nullif({d}, 0e0))"
        return f"CASE WHEN {flat} THEN 0e0 ELSE least({a}, {b}) END", f"CASE WHEN {flat} THEN 1e0 ELSE greatest({a}, {b}) END", f"(NOT {flat} OR ({p} >= {low} AND {p} <= {high}))"

    lx, hx, okx = clip(x0, x1, f"{w}.min_lon", f"{w}.max_lon")
    ly, hy, oky = clip(y0, y1, f"{w}.min_lat", f"{w}.max_lat")
    return f"({okx} AND {oky} AND greatest(0e0, {lx}, {ly}) <= least(1e0, {hx}, {hy}))"
