"""SQL that states the results of the order-dependent tests: a scan over the stations as one recursion.

Stations are taken in the order of their ids, one for each step of the recursion; what a step reads and leaves is the
list of all flags.  Matrices are lists of rows, inverted by Gauss-Jordan steps, so boxes and circles must be small.
"""

from __future__ import annotations

#: A circle's stations with what the tests need of each; `around` is ordered by distance.
_NETWORK = """WITH RECURSIVE s AS ({stations}), o AS (SELECT *, row_number() OVER (ORDER BY station_id) AS k FROM s),
g AS (SELECT *, {parts} FROM o),
d AS (SELECT a.k AS me, {{'k': b.k, 'v': b.value, 'e': b.elev, 'cla': cos(radians(b.lat)), 'sla': sin(radians(b.lat)), 'lo': radians(b.lon), 'lat': b.lat, 'lon': b.lon,
    'd': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))}} AS p FROM g a JOIN g b
  ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= {outer}),
n AS MATERIALIZED (SELECT me AS k, list(p ORDER BY p.d, p.k) AS around FROM d GROUP BY me),
l AS MATERIALIZED (SELECT count(*) AS stations, min(value) AS low, max(value) AS high FROM s)"""

_APART = """CASE WHEN a.lat = b.lat AND a.lon = b.lon THEN 0e0
  ELSE acos(least(1e0, greatest(-1e0, a.cla * b.cla * cos(a.lo - b.lo) + a.sla * b.sla))) * 6378137e0 END"""


def _inverse(name: str, matrix: str, most: int) -> list[str]:
    """Levels that add `name`, the inverse of the matrix of up to `most` rows, beside the given columns."""
    size = f"len({matrix})"
    begin = f"list_transform({matrix}, lambda r, i: list_concat(r, list_transform(range(1, {size} + 1), lambda c: CASE WHEN c = i THEN 1e0 ELSE 0e0 END)))"
    levels = [f"{begin} AS {name}_0"]
    for j in range(1, most + 1):
        m = f"{name}_{j - 1}"
        row = f"list_transform({m}, lambda r, i: CASE WHEN i = {j} THEN list_transform(r, lambda x: x / {m}[{j}][{j}]) ELSE list_transform(r, lambda x, c: x - r[{j}] * {m}[{j}][c] / {m}[{j}][{j}]) END)"
        levels.append(f"CASE WHEN {size} >= {j} THEN {row} ELSE {m} END AS {name}_{j}")
    levels.append(f"list_transform({name}_{most}, lambda r: r[{size} + 1 :]) AS {name}")
    return levels


def _nested(source: str, levels: list[str]) -> str:
    """Columns added one after the other, so that each can name those before it."""
    for level in levels:
        source = f"SELECT *, {level} FROM ({source})"
    return source


def _sums(matrix: str, vector: str) -> str:
    return f"list_transform({matrix}, lambda r: list_sum(list_transform(r, lambda x, c: x * {vector}[c])))"


def _distances(points: str) -> str:
    return f"list_transform({points}, lambda a: list_transform({points}, lambda b: {_APART}))"


def _correlations(points: str, distances: str, scale: str, vertical: float, noise: float) -> str:
    return f"""list_transform({distances}, lambda r, i: list_transform(r, lambda x, c:
      exp(-0.5 * (x / {scale}) * (x / {scale}) - 0.5 * pow(({points}[i].e - {points}[c].e) / {vertical}e0, 2)) + CASE WHEN i = c THEN {noise}e0 ELSE 0 END))"""


def _kth_scale(kth: int, low: float, high: float) -> str:
    return f"least({high}e0, greatest({low}e0, list_avg(list_transform(far, lambda r: list_sort(r)[least({kth}, len(r))]))))"


def spatial_consistency(stations: str, parts: str, num_min: int, num_max: int, inner: float, outer: float, iterations: int, least_scale: float, vertical: float, threshold: float, eps2: float) -> str:
    """station_id, flag, prob_gross_error; the background is the mean of the box."""
    box = f"CASE WHEN checked[k] OR flags[k] <> 0 THEN [] ELSE list_filter(around, lambda p: flags[p.k] = 0)[1 : {num_max}] END AS box"
    bad = "cv < 0 AND e > {0} OR cv >= 0 AND e > {0}".format(f"{threshold}e0")
    levels = [
        box, f"CASE WHEN len(box) >= {num_min} THEN box ELSE [] END AS used", f"{_distances('used')} AS far",
        f"greatest({least_scale}e0, list_avg(list_transform(far, lambda r: list_aggregate(r, 'quantile_cont', 0.1)))) AS scale",
        f"{_correlations('used', 'far', 'scale', vertical, eps2)} AS matrix", *_inverse("inv", "matrix", num_max),
        "list_avg(list_transform(used, lambda p: p.v)) AS mean", "list_transform(used, lambda p: p.v - mean) AS off", f"{_sums('inv', 'off')} AS q",
        f"greatest(0.01, list_avg(list_transform(off, lambda x, i: x * {eps2} * q[i]))) AS var",
        f"list_filter(list_transform(used, lambda p, i: {{'k': p.k, 'd': p.d, 'cv': -q[i] / inv[i][i], 'e': q[i] / inv[i][i] * {eps2} * q[i] / var}}), lambda x: x.d <= {inner}) AS found",
        f"list_transform(list_filter(found, lambda x: {bad.replace('cv', 'x.cv').replace(' e >', ' x.e >')}), lambda x: x.k) AS thrown_now",
        "list_transform(found, lambda x: x.k) AS seen",
        "list_transform(flags, lambda f, i: CASE WHEN list_contains(thrown_now, i) THEN 1 ELSE f END) AS new_flags",
        f"list_transform(checked, lambda c, i: c OR list_contains(seen, i) OR i = k AND len(box) < {num_min}) AS new_checked",
        "list_transform(score, lambda s, i: CASE WHEN list_contains(seen, i) THEN greatest(s, found[list_position(seen, i)].e) ELSE s END) AS new_score",
        "thrown + len(thrown_now) AS total", "k = stations AS last", f"last AND (total = 0 OR turn = {iterations}) AS ended",
    ]
    step = _nested("SELECT state.*, around, stations FROM state JOIN n ON n.k = state.k, l WHERE NOT state.done", levels)
    network = _NETWORK.format(stations=stations, parts=parts, outer=outer)
    return f"""{network}, state AS (
  SELECT CAST(1 AS BIGINT) AS k, 1 AS turn, CAST(0 AS BIGINT) AS thrown, FALSE AS done, list_transform(range(stations), lambda i: 0) AS flags, list_transform(range(stations), lambda i: FALSE) AS checked,
    list_transform(range(stations), lambda i: 0e0) AS score FROM l
  UNION ALL SELECT CASE WHEN last THEN 1 ELSE k + 1 END, CASE WHEN last THEN turn + 1 ELSE turn END, CASE WHEN last THEN 0 ELSE total END, ended, new_flags,
    CASE WHEN last THEN list_transform(new_flags, lambda f: f <> 0) ELSE new_checked END, new_score FROM ({step})),
final AS (SELECT flags, score FROM state WHERE done)
SELECT station_id, CAST(flags[k] AS INTEGER) AS flag, round(score[k], 4) AS prob_gross_error FROM o, final"""


def _circles(stations: str, parts: str, num_min: int, num_max: int, inner: float, outer: float, iterations: int, two_inside: bool, levels: list[str], good: str, verdict: str) -> str:
    """station_id, flag of a test in circles.

    levels: columns made of `circle` (stations of the outer circle), `inside` (those of the inner one) and `test`.  good:
    whether all to test are evidently good.  verdict: {{'ks': stations flagged bad, 'open': nothing can be said}}.
    """
    inside = "len(inside) < 2" if two_inside else "FALSE"
    every = [
        "CASE WHEN pass = 3 THEN flags[k] = 1 ELSE flags[k] < 0 END AS active",
        f"CASE WHEN NOT active THEN [] WHEN pass = 1 THEN list_filter(around[1 : {num_max}], lambda p: flags[p.k] <> 1) ELSE list_append(list_filter(around[1 : {num_max}], lambda p: flags[p.k] <> 1 AND p.k <> state_k), around[list_position(list_transform(around, lambda p: p.k), state_k)]) END AS near",
        f"list_filter(near, lambda p: p.d <= {inner}) AS inside",
        f"CASE WHEN NOT active THEN 'none' WHEN len(near) < {num_min} THEN 'outer' WHEN {inside} THEN 'inner' ELSE 'judge' END AS what",
        "CASE WHEN what = 'judge' THEN near ELSE [] END AS circle",
        "CASE WHEN pass = 1 THEN list_filter(inside, lambda p: flags[p.k] <> 0) ELSE list_filter(inside, lambda p: p.k = state_k) END AS test",
        *levels,
        f"CASE WHEN what = 'judge' THEN {good} END AS good", f"CASE WHEN what = 'judge' AND NOT good THEN {verdict} END AS said",
        "pass > 1 OR turn > 1 AS settle",
        """CASE WHEN what IN ('outer', 'inner') THEN [k] WHEN what = 'none' THEN [] WHEN good THEN list_transform(test, lambda p: p.k)
          WHEN len(said.ks) > 0 THEN said.ks WHEN settle AND NOT said.open THEN list_transform(test, lambda p: p.k) ELSE [] END AS changed""",
        "CASE WHEN what = 'outer' THEN 12 WHEN what = 'inner' THEN 11 WHEN good THEN 0 WHEN len(said.ks) > 0 THEN 1 ELSE 0 END AS flag",
        "list_transform(flags, lambda f, i: CASE WHEN list_contains(changed, i) THEN flag ELSE f END) AS new_flags",
        "thrown + CASE WHEN flag = 1 THEN len(changed) ELSE 0 END AS total", "k = stations AS last",
        f"pass = 1 AND last AND total > 0 AND turn < {iterations} AS again",
        "CASE WHEN pass = 1 AND last AND total = 0 AND turn = 1 THEN list_transform(new_flags, lambda f: CASE WHEN f = -999 THEN 0 ELSE f END) ELSE new_flags END AS kept_flags",
    ]
    step = _nested("SELECT state.*, state.k AS state_k, around, stations, low, high FROM state JOIN n ON n.k = state.k, l WHERE state.pass <= 3", every)
    network = _NETWORK.format(stations=stations, parts=parts, outer=outer)
    return f"""{network}, state AS (
  SELECT CAST(1 AS BIGINT) AS k, 1 AS pass, 1 AS turn, CAST(0 AS BIGINT) AS thrown, list_transform(range(stations), lambda i: -999) AS flags FROM l
  UNION ALL SELECT CASE WHEN last THEN 1 ELSE k + 1 END, CASE WHEN last AND NOT again THEN pass + 1 ELSE pass END, CASE WHEN again THEN turn + 1 ELSE turn END,
    CASE WHEN last THEN 0 ELSE total END, kept_flags FROM ({step})),
final AS (SELECT flags FROM state WHERE pass = 4)
SELECT station_id, CAST(flags[k] AS INTEGER) AS flag FROM o, final"""


def _worst(estimate: str, chi: str, tolerance: float, admissible: float, threshold: float) -> tuple[list[str], str]:
    """The station to test whose deviation stands out most among those with an admissible estimate (structs p, y, c)."""
    levels = [
        f"list_transform(inside, lambda p: {{'k': p.k, 'v': p.v, 'y': {estimate}, 'c': {chi}}}) AS judged",
        f"list_transform(list_filter(judged, lambda p: p.y >= p.v - {admissible} AND p.y <= p.v + {admissible}), lambda p: p.c) AS fair",
        "list_aggregate(fair, 'quantile_cont', 0.75) - list_aggregate(fair, 'quantile_cont', 0.25) AS sigma",
        f"""list_transform(list_filter(judged, lambda p: list_contains(list_transform(test, lambda t: t.k), p.k) AND (p.y < p.v - {tolerance} OR p.y > p.v + {tolerance}) AND p.c IS NOT NULL),
          lambda p: {{'z': (p.c - list_aggregate(fair, 'median')) / (sigma + sigma / sqrt(len(fair))), 'k': p.k}}) AS outside""",
        "list_filter(outside, lambda x: x.z = list_max(list_transform(outside, lambda y: y.z)))[1] AS worst",
    ]
    verdict = f"""CASE WHEN len(fair) = 0 THEN {{'ks': list_transform(test, lambda t: t.k), 'open': FALSE}} WHEN sigma = 0 THEN {{'ks': CAST([] AS BIGINT[]), 'open': TRUE}}
      WHEN worst.z > {threshold} THEN {{'ks': [worst.k], 'open': FALSE}} ELSE {{'ks': CAST([] AS BIGINT[]), 'open': FALSE}} END"""
    return levels, verdict


_MEDIAN = "list_aggregate(list_transform(circle, lambda p: p.v), 'median') AS centre"


def _good(estimate: str, tolerance: float) -> str:
    within = f"list_bool_and(list_transform(test, lambda p: {estimate} {{0}}= p.v - {tolerance} AND {estimate} {{1}}= p.v + {tolerance}))"
    return f"CASE WHEN pass = 1 THEN {within.format('>', '<')} ELSE {within.replace('=', '').format('>', '<')} END"


def first_guess(stations: str, parts: str, num_min: int, num_max: int, inner: float, outer: float, iterations: int, admissible: float, tolerance: float, threshold: float) -> str:
    """Against the median of the outer circle; ranges are the values give or take admissible and tolerance."""
    levels, verdict = _worst("centre", "abs(p.v - centre)", tolerance, admissible, threshold)
    return _circles(stations, parts, num_min, num_max, inner, outer, iterations, True, [_MEDIAN, *levels], _good("centre", tolerance), verdict)


def resistant(stations: str, parts: str, num_min: int, num_max: int, inner: float, outer: float, iterations: int, scales: tuple[float, float, int, float], admissible: float, tolerance: float, eps2: float, threshold: float) -> str:
    low, high, kth, vertical = scales
    held = f"least(high + {admissible}, greatest(low - {admissible}, {{}}))"
    at = "list_position(ks, p.k)"
    left_out = held.format(f"p.v - q[{at}] / inv[{at}][{at}]")
    analysis = held.format(f"p.v - {eps2} * q[{at}]")
    product = f"(p.v - {analysis}) * (p.v - {left_out})"
    before = [
        _MEDIAN, "list_transform(circle, lambda p: p.k) AS ks", f"{_distances('circle')} AS far", f"{_kth_scale(kth, low, high)} AS scale",
        f"{_correlations('circle', 'far', 'scale', vertical, eps2)} AS matrix", *_inverse("inv", "matrix", num_max + 1),
        "list_transform(circle, lambda p: p.v - centre) AS off", f"{_sums('inv', 'off')} AS q",
    ]
    levels, verdict = _worst(left_out, f"CASE WHEN {product} >= 0 THEN sqrt({product}) END", tolerance, admissible, threshold)
    return _circles(stations, parts, num_min, num_max, inner, outer, iterations, True, [*before, *levels], _good("centre", tolerance), verdict)


def dual(stations: str, parts: str, event: str, num_min: int, num_max: int, inner: float, outer: float, iterations: int, scales: tuple[float, float, int, float], threshold: float) -> str:
    low, high, kth, vertical = scales
    levels = [f"{_distances('circle')} AS far", f"{_kth_scale(kth, low, high)} AS scale"]
    for name, kind in (("yes", event), ("no", f"NOT ({event})")):
        levels += [
            f"list_filter(circle, lambda p: {kind}) AS {name}", f"{_distances(name)} AS far_{name}", f"{_correlations(name, f'far_{name}', 'scale', vertical, 0.1)} AS matrix_{name}",
            *_inverse(f"inv_{name}", f"matrix_{name}", num_max + 1), f"list_transform(inv_{name}, lambda r: list_sum(r)) AS weight_{name}",
        ]

    def found(own: str, other: str) -> str:
        near = f"list_sum(list_transform({other}, lambda b, i: weight_{other}[i] * exp(-0.5 * pow(({_APART}) / scale, 2) - 0.5 * pow((a.e - b.e) / {vertical}e0, 2))))"
        return f"list_transform({own}, lambda a, j: {{'k': a.k, 'own': 1 - weight_{own}[j] / inv_{own}[j][j], 'other': {near}}})"

    levels += [
        f"list_concat({found('yes', 'no')}, {found('no', 'yes')}) AS pairs",
        "list_transform(list_filter(pairs, lambda x: list_contains(list_transform(test, lambda t: t.k), x.k)), lambda x: {'k': x.k, 'own': CASE WHEN x.own <= 0 THEN 0.001 ELSE x.own END, 'other': x.other}) AS held",
        "list_transform(list_filter(held, lambda x: (x.own >= 0.45 OR x.other >= 0.45) AND x.other > x.own), lambda x: {'z': x.other * ln(x.other / x.own), 'k': x.k}) AS outside",
        "list_filter(outside, lambda x: x.z = list_max(list_transform(outside, lambda y: y.z)))[1] AS worst",
    ]
    verdict = f"{{'ks': CASE WHEN worst.z > {threshold} THEN [worst.k] ELSE CAST([] AS BIGINT[]) END, 'open': FALSE}}"
    return _circles(stations, parts, num_min, num_max, inner, outer, iterations, False, levels, "len(yes) = 0 OR len(no) = 0", verdict)


def profiles(stations: str, group: str) -> str:
    """station_id, background: five-parameter profiles of groups by the downhill simplex, a step of it for each step of the recursion.

    The groups must be large and their elevations spread.
    """
    part = "CASE WHEN abs(p[5]) > 0 THEN greatest(0e0, least(1e0, (z.z - p[4]) / abs(p[5]))) WHEN z.z > p[4] THEN 1e0 ELSE 0e0 END"
    at = f"p[1] + p[2] * z.z - p[3] / 2 * (1 + cos(pi() * ({part})))"

    def cost(point: str) -> str:
        square = at.replace("p[", f"{point}[")
        return f"ln(greatest(1e-6, sqrt(list_avg(list_transform(zs, lambda z: pow({square} - z.v, 2))))))"

    def between(a: str, b: str, wa: float, wb: float) -> str:
        return f"list_transform({a}, lambda u, c: {wa} * u + {wb} * {b}[c])"

    worst = "list_transform(x, lambda p, i: CASE WHEN i = worst THEN {} ELSE p END)"
    worse = "list_transform(y, lambda p, i: CASE WHEN i = worst THEN {} ELSE p END)"
    step = _nested("SELECT state.*, zs FROM state JOIN v USING (grp) WHERE NOT done", [
        "list_position(y, list_max(y)) AS worst", "list_filter(x, lambda p, i: i <> worst) AS rest", "list_max(list_filter(y, lambda p, i: i <> worst)) AS second",
        "list_transform(range(1, 6), lambda c: list_avg(list_transform(rest, lambda p: p[c]))) AS centre", f"{between('centre', 'x[worst]', 2, -1)} AS trial", f"{cost('trial')} AS value",
        f"CASE WHEN value < list_min(y) THEN 'far' WHEN value < second THEN 'take' ELSE 'in' END AS way",
        f"{between('centre', 'x[worst]', 3, -2)} AS further", f"CASE WHEN way = 'far' THEN {cost('further')} END AS beyond",
        "CASE WHEN way = 'in' AND value >= y[worst] THEN x[worst] ELSE trial END AS corner", "CASE WHEN way = 'in' AND value >= y[worst] THEN y[worst] ELSE value END AS height",
        f"{between('centre', 'corner', 0.5, 0.5)} AS inside", f"CASE WHEN way = 'in' THEN {cost('inside')} END AS closer",
        "list_transform(y, lambda p, i: CASE WHEN i = worst THEN height ELSE p END) AS heights", "list_transform(x, lambda p, i: CASE WHEN i = worst THEN corner ELSE p END) AS corners",
        "list_position(heights, list_min(heights)) AS best",
        f"""CASE WHEN way = 'far' AND beyond < list_min(y) THEN {worst.format('further')} WHEN way <> 'in' THEN corners WHEN closer < height THEN {worst.format('inside')}
          ELSE list_transform(corners, lambda p: {between('p', 'corners[best]', 0.5, 0.5)}) END AS new_x""",
        f"""CASE WHEN way = 'far' AND beyond < list_min(y) THEN {worse.format('beyond')} WHEN way <> 'in' THEN heights WHEN closer < height THEN {worse.format('closer')}
          ELSE list_transform(new_x, lambda p, i: CASE WHEN i = best THEN heights[best] ELSE {cost('p')} END) END AS new_y""",
        "list_transform(range(1, 6), lambda c: list_avg(list_transform(new_x, lambda p: p[c]))) AS middle",
        "sqrt(list_avg(list_transform(new_x, lambda p: list_sum(list_transform(p, lambda q, c: pow(q - middle[c], 2)))))) AS size",
    ])
    return f"""WITH RECURSIVE s AS ({stations}), w AS (SELECT *, {group} AS grp FROM s),
v AS MATERIALIZED (SELECT grp, list({{'z': elev, 'v': value}} ORDER BY station_id) AS zs, avg(value) AS mean, quantile_cont(elev, 0.1) AS h0, quantile_cont(elev, 0.9) AS h1 FROM w GROUP BY grp),
a AS (SELECT grp, zs, [mean, -0.0065e0, 5e0, h0, h1] AS base FROM v),
b AS (SELECT grp, zs, list_concat([base], list_transform(range(1, 6), lambda i: list_transform(base, lambda q, c: CASE WHEN c = i THEN q + 1 ELSE q END))) AS x FROM a),
state AS (SELECT grp, 0 AS steps, FALSE AS done, x, list_transform(x, lambda p: {cost('p')}) AS y FROM b
  UNION ALL SELECT grp, steps + 1, size < 0.01 OR steps = 99, new_x, new_y FROM ({step})),
f AS (SELECT grp, x[list_position(y, list_min(y))] AS p FROM state WHERE done)
SELECT station_id, round({at.replace('z.z', 'elev')}, 4) AS background FROM w JOIN f USING (grp)"""
