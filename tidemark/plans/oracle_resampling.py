"""Oracle SQL of exact resampling: the trie's forks, their distribution functions and the walk of every replicate down to the values."""

from __future__ import annotations

_WHOLE = "18446744073709551616::UHUGEINT"


def _mixed(z: str) -> str:
    """The splitmix64 finaliser of an unsigned 64-bit expression; one-element lists bind each step's value once."""
    step = lambda shift, factor: f"lambda z: ((xor(z, z >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_WHOLE})::UBIGINT"
    first = f"list_transform([({z})::UBIGINT], {step(30, 0xBF58476D1CE4E5B9)})"
    return f"list_transform(list_transform({first}, {step(27, 0x94D049BB133111EB)}), lambda z: xor(z, z >> 31))[1]"


def _lf(n: str) -> str:
    return f"lgamma({n} + 1.0::DOUBLE)"


def key(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15)) AS BIGINT)"


def resampled(name: str, leaves: str, replicates: int, with_replacement: bool) -> dict[str, str]:
    """Steps ending in ``name``_sums (g, r, drawn, m1, m2) from ``leaves`` (g, salt, drawn, key, n, m1, m2)."""
    n = name
    if with_replacement:
        high = "q"
        log_p = f"{_lf('q')} - {_lf('k')} - {_lf('(q - k)')} + k * ln(left_n / total::DOUBLE) + (q - k) * ln(1 - left_n / total::DOUBLE)"
        low = "0"
    else:
        low, high = "greatest(0, q - (total - left_n))", "least(left_n, q)"
        log_p = (f"{_lf('left_n')} - {_lf('k')} - {_lf('(left_n - k)')} + {_lf('(total - left_n)')} - {_lf('(q - k)')} - {_lf('(total - left_n - q + k)')}"
                 f" - {_lf('total')} + {_lf('q')} + {_lf('(total - q)')}")
    return {
        f"{n}_leaves": leaves,
        f"{n}_forks": f"""
SELECT g, salt, drawn, d, key >> (60 - d) AS pre, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE (key >> (59 - d)) & 1 = 0) AS BIGINT) AS left_n,
  {_mixed('xor(any_value(salt), (1::BIGINT << d) | (key >> (60 - d)))')} AS start
FROM {n}_leaves, (SELECT unnest(range(60)) AS d) GROUP BY g, salt, drawn, d, key >> (60 - d) HAVING count(DISTINCT (key >> (59 - d)) & 1) = 2""",
        f"{n}_kids": f"""
SELECT f.g, f.d, f.pre, s.s, coalesce(min(c.d), 60) AS kid_d, coalesce(arg_min(c.pre, c.d), any_value(l.key)) AS kid_pre
FROM {n}_forks f CROSS JOIN (SELECT unnest([0, 1]) AS s) s
LEFT JOIN {n}_forks c ON c.g = f.g AND c.d > f.d AND (c.pre >> (c.d - f.d - 1)) = f.pre * 2 + s.s
LEFT JOIN {n}_leaves l ON l.g = f.g AND (l.key >> (59 - f.d)) = f.pre * 2 + s.s GROUP BY ALL""",
        f"{n}_sizes": f"""
SELECT *, unnest(range(CAST(greatest(0, floor(mean - 10 * sqrt(mean) - 20)) AS BIGINT), CAST(least({'drawn' if with_replacement else 'least(drawn, total)'}, ceil(mean + 10 * sqrt(mean) + 20)) AS BIGINT) + 1)) AS q
FROM (SELECT f.*, f.drawn * f.total / a.n::DOUBLE AS mean FROM {n}_forks f JOIN (SELECT g, sum(n) AS n FROM {n}_leaves GROUP BY g) a ON a.g = f.g)""",
        f"{n}_odds": f"""
SELECT g, d, pre, q, any_value(start) AS start, min(k) AS low, list(p ORDER BY k) AS odds FROM (
  SELECT g, d, pre, q, k, start, sum(exp({log_p})) OVER (PARTITION BY g, d, pre, q ORDER BY k) AS p
  FROM (SELECT *, unnest(range({low}, {high} + 1)) AS k FROM {n}_sizes)) GROUP BY g, d, pre, q""",
        f"{n}_walk": f"""
SELECT l.g, r.r, coalesce(t.d, 60) AS d, coalesce(t.pre, l.key) AS pre, l.drawn AS q
FROM (SELECT g, any_value(drawn) AS drawn, any_value(key) AS key FROM {n}_leaves GROUP BY g) l
LEFT JOIN (SELECT g, min(d) AS d, arg_min(pre, d) AS pre FROM {n}_forks GROUP BY g) t ON t.g = l.g CROSS JOIN (SELECT unnest(range({replicates})) AS r) r
UNION ALL
SELECT w.g, w.r, c.kid_d, c.kid_pre, CASE WHEN c.s = 0 THEN w.k ELSE w.q - w.k END FROM (
  SELECT g, d, pre, q, r, low + len(list_filter(odds, lambda x: x < u)) AS k FROM (
    SELECT v.*, o.low, o.odds, (({_mixed(f'(o.start::UHUGEINT + v.r::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {_WHOLE}')} >> 11)::DOUBLE + 0.5) / 9007199254740992.0 AS u
    FROM {n}_walk v JOIN {n}_odds o ON o.g = v.g AND o.d = v.d AND o.pre = v.pre AND o.q = v.q)) w
  JOIN {n}_kids c ON c.g = w.g AND c.d = w.d AND c.pre = w.pre""",
        f"{n}_sums": f"""
SELECT w.g, w.r, sum(w.q) AS drawn, sum(w.q * l.m1) AS m1, sum(w.q * l.m2) AS m2 FROM {n}_walk w JOIN {n}_leaves l ON l.g = w.g AND w.d = 60 AND l.key = w.pre GROUP BY w.g, w.r""",
    }
