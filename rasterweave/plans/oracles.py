"""DuckDB SQL for the queries, by other routes than theirs where there is one."""

from __future__ import annotations

from rasterweave.plans.adapters import CHANNELS, DEEP, HEADERS, RASTER, RGBA

#: Rows of the raster.
H = "(SELECT count(*) FROM embeddings)"
ORDER = "ORDER BY z, zback, t1, t2, t3, t4"
ORACLES: dict[str, str] = {}


def _over(values: str, where: str = "TRUE") -> str:
    """The over composite by running transparency: a sample counts as much as the product of (1 - alpha) of those before it."""
    sums = ", ".join(f"round(sum(t * {v}), 6) AS {v}" for v in values.split())
    return f"""seen AS (SELECT *, coalesce(product(greatest(1 - a, 0)) OVER (PARTITION BY y, x {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS t FROM deep WHERE {where}),
done AS (SELECT y, x, {sums}, round(least(greatest(sum(t * a), 0.0), 1.0), 6) AS a FROM seen GROUP BY y, x)"""


_PLAIN = f"WITH {DEEP}, {_over('r g b')} SELECT y, x, r, g, b, a FROM done"
ORACLES |= {
    "d3_over_composite": _PLAIN,
    "d3_over_composite_in_runs": _PLAIN,
    "d8_volumetric_composite": _PLAIN,
    "d4_all_channel_composite": f"WITH {DEEP}, {_over('r g b z zback').replace('t * z)', 't * z) / 7919').replace('t * zback)', 't * zback) / 7919')} SELECT * FROM done",
    "d5b_tile_merge": f"WITH {DEEP}, {_over('r g b', 'x BETWEEN 32 AND 63 AND y BETWEEN 0 AND 15')} SELECT * FROM done",
    "d5_multi_source_merge": f"""WITH {DEEP}, {_over('r g b')},
grid AS (SELECT y, x FROM (SELECT unnest(range((SELECT max(y) + 1 FROM deep))) AS y), (SELECT unnest(range(128)) AS x))
SELECT grid.y, grid.x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM grid LEFT JOIN done ON grid.y = done.y AND grid.x = done.x""",
    "d1_sample_counts": f"WITH {DEEP} SELECT y, x, count(*) AS n FROM deep GROUP BY y, x",
    "d1_sample_totals": f"WITH {DEEP} SELECT sum(n)::BIGINT AS total, max(n) AS most, count(*) AS pixels FROM (SELECT count(*) AS n FROM deep GROUP BY y, x)",
    "d1b_count_table": f"WITH {DEEP} SELECT y, x, n, sum(n) OVER (ORDER BY y, x)::BIGINT AS packed FROM (SELECT y, x, count(*) AS n FROM deep GROUP BY y, x)",
    "d1b_count_table_lines": f"WITH {DEEP} SELECT y, x, n, sum(n) OVER (PARTITION BY y ORDER BY x)::BIGINT AS packed, n AS unpacked FROM (SELECT y, x, count(*) AS n FROM deep GROUP BY y, x)",
    "d2_depth_sort": f"WITH {DEEP} SELECT y, x, (row_number() OVER (PARTITION BY y, x {ORDER}) - 1)::INTEGER AS i, z, zback, round(a, 6) AS a FROM deep",
    "d5c_sample_budget": f"WITH {DEEP} SELECT y, count(*) AS n, count(*) > 500 AS over FROM deep GROUP BY y",
    "d6_state_check": f"""WITH {DEEP}, seq AS (SELECT y, x, z, row_number() OVER w - 1 AS sample, lag(z) OVER w AS pz, lag(zback) OVER w AS pb FROM deep WINDOW w AS (PARTITION BY y, x ORDER BY t1, t2, t3, t4))
SELECT y, x, min(sample)::INTEGER AS sample, arg_min(CASE WHEN z < pz THEN 'sorted' ELSE 'nonoverlapping' END, sample) AS rule FROM seq WHERE z < pz OR z < pb GROUP BY y, x""",
    "d7_predicates": f"WITH {DEEP} SELECT src, count(*) FILTER (WHERE zback <> z) AS volumetric, count(*) FILTER (WHERE a >= 1) AS opaque FROM deep GROUP BY src",
    "d9_custom_compositor": f"WITH {DEEP} SELECT y, x, min(z) AS z, round(max(a), 6) AS a FROM deep GROUP BY y, x",
    "d10_sample_access": f"WITH {DEEP} SELECT y, x, last(zback {ORDER}) AS last_zback, round(sum(a {ORDER}), 6) AS sum_a FROM deep GROUP BY y, x",
}

_LEVELS = """lv AS (
  SELECT h.*, lx, ly, greatest(1, CASE WHEN up THEN ceil(w / pow(2, lx)) ELSE floor(w / pow(2, lx)) END)::BIGINT AS lw,
    greatest(1, CASE WHEN up THEN ceil(h / pow(2, ly)) ELSE floor(h / pow(2, ly)) END)::BIGINT AS lh
  FROM (SELECT *, CASE WHEN up THEN ceil(log2(w)) ELSE floor(log2(w)) END AS kx, CASE WHEN up THEN ceil(log2(h)) ELSE floor(log2(h)) END AS ky FROM headers) AS h,
    (SELECT unnest(range(14))::INTEGER AS lx), (SELECT unnest(range(14))::INTEGER AS ly)
  WHERE CASE mode WHEN 'one' THEN lx = 0 AND ly = 0 WHEN 'mipmap' THEN lx = ly AND lx <= greatest(kx, ky) ELSE lx <= kx AND ly <= ky END),
tl AS (SELECT *, ceil(lw / tw)::BIGINT AS nx, ceil(lh / th)::BIGINT AS ny FROM lv),
ft AS (SELECT a.*, coalesce((SELECT sum(b.nx * b.ny) FROM tl b WHERE b.id = a.id AND (b.ly, b.lx) < (a.ly, a.lx)), 0)::BIGINT AS first FROM tl a)"""
_CAT = f"""WITH {HEADERS.replace('FROM part)', 'FROM part WHERE %s)')}, {_LEVELS},
cat AS (SELECT id, first + ty * nx + tx AS idx, lx, ly, tx, ty, tx * tw AS x0, ty * th AS y0, least((tx + 1) * tw, lw) - 1 AS x1, least((ty + 1) * th, lh) - 1 AS y1
  FROM ft, LATERAL (SELECT unnest(range(nx)) AS tx), LATERAL (SELECT unnest(range(ny)) AS ty)),
sized AS (SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) * 4 + 20 AS length FROM cat),
chunks AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM sized)
"""
ORACLES |= {
    "g1_level_counts": f"""WITH {HEADERS} SELECT id,
CASE WHEN up THEN 1 + len(list_filter(range(32), lambda k: (1::BIGINT << k) < w)) ELSE len(list_filter(range(32), lambda k: (1::BIGINT << k) <= w)) END AS nx,
CASE WHEN up THEN 1 + len(list_filter(range(32), lambda k: (1::BIGINT << k) < h)) ELSE len(list_filter(range(32), lambda k: (1::BIGINT << k) <= h)) END AS ny FROM headers""",
    "g2_level_sizes": f"WITH {HEADERS}, {_LEVELS} SELECT id, lx, ly, lw, lh FROM lv",
    "g3_tile_counts": f"WITH {HEADERS}, {_LEVELS} SELECT id, lx, ly, nx, ny FROM tl",
    "g4_tile_chunk_index": f"WITH {HEADERS}, {_LEVELS} SELECT id, lx, ly, first FROM ft",
    "g5_chunk_counts": f"""WITH {HEADERS}, {_LEVELS}
SELECT id, sum(nx * ny)::BIGINT AS tiles, any_value(ceil(h / CASE WHEN compression IN (3, 5) THEN 16 WHEN compression IN (4, 6, 7, 8, 11) THEN 32 WHEN compression IN (9, 10) THEN 256 ELSE 1 END))::BIGINT AS scanline_chunks FROM tl GROUP BY id""",
    "g6_box_predicates": f"WITH {HEADERS} SELECT id, w AS width, w < 1 OR h < 1 AS empty, min_x <= 20 AND min_x + w > 20 AND min_y <= 30 AND min_y + h > 30 AS has, w::BIGINT * h AS area FROM headers",
    "g7_box_union": f"WITH {HEADERS} SELECT brand, min(min_x) AS x0, min(min_y) AS y0, max(min_x + w) - 1 AS x1, max(min_y + h) - 1 AS y1 FROM headers GROUP BY brand",
    "g8_lines_per_chunk": f"WITH {HEADERS} SELECT DISTINCT compression, CASE WHEN compression IN (3, 5) THEN 16 WHEN compression IN (4, 6, 7, 8, 11) THEN 32 WHEN compression IN (9, 10) THEN 256 ELSE 1 END AS lines, (compression BETWEEN 5 AND 9)::INTEGER AS lossy FROM headers",
    "g9_sampled_rows": f"WITH {HEADERS} SELECT id, count(*) AS rows, min(y) AS first, 7 AS stored FROM (SELECT id, unnest(range(min_y, min_y + 21)) AS y FROM headers) WHERE (y + 300) % 3 = 0 GROUP BY id",
    "g10_tile_extent": f"WITH {HEADERS} SELECT id, tx, min_x + tx * tw AS x0, least(min_x + w, min_x + (tx + 1) * tw) - 1 AS x1 FROM (SELECT *, unnest(range(ceil(w / tw)::BIGINT)) AS tx FROM headers)",
    "s3_viewport": f"WITH {RASTER} SELECT y, x, round(v, 6) AS v FROM raster WHERE x >= 10 AND x < 42 AND y >= 100",
    "s3_viewport_cost": "SELECT count(*) AS chunks, sum((least(tx * 16 + 16, 64) - tx * 16) * (least(ty * 32 + 32, n) - ty * 32) * 4 + 20)::BIGINT AS bytes FROM (SELECT count(*) AS n FROM embeddings), range(4) AS a(tx), range(2000) AS b(ty) WHERE ty * 32 < n AND tx <= 2 AND ty * 32 < 200 AND least(ty * 32 + 32, n) > 100",
    "s4_chunk_catalogue": _CAT.replace("%s", "p_size % 4 <> 0") + "SELECT id, lx, ly, count(*) AS chunks, sum(length)::BIGINT AS bytes, min(place) AS first, max(idx) AS last_idx FROM chunks GROUP BY id, lx, ly",
    "s4b_chunks_for_scanlines": _CAT.replace("%s", "p_partkey % 3 = 0") + "SELECT id, idx, tx, ty FROM chunks WHERE y1 >= 90 AND y0 <= 200",
    "s4c_chunks_for_region": _CAT.replace("%s", "p_partkey % 3 = 1") + "SELECT id, idx, tx, ty FROM chunks WHERE lx = 1 AND ly = 1 AND NOT (x1 < 8 OR x0 > 47 OR y1 < 16 OR y0 > 63)",
    "s5_part_selection": f"WITH {HEADERS} SELECT brand, min(id) AS first_part, count(*) AS parts FROM headers WHERE brand = 'Brand#12' AND NOT deep GROUP BY brand",
    "s2_rgba_read": f"WITH {RGBA} SELECT y, x, round(r, 6) AS r, round(g, 6) AS g, 0.0::DOUBLE AS b, 1.0::DOUBLE AS a FROM rgba",
    "s10_channel_extract": f"WITH {RGBA} SELECT y, x, round(g::FLOAT::DOUBLE, 6) AS v FROM rgba",
    "s11_six_faces": f"WITH {RGBA} SELECT y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM rgba WHERE y < 96",
}


def _level(source: str, terms: str, height: str = "(SELECT max(y) + 1 FROM raster)") -> str:
    """A level by gathering: each target cell joins the cells at its offsets (o, w)."""
    return f"""{source}, taps(o, w) AS (VALUES {terms}),
cells AS (SELECT Y.t AS y, X.t::INTEGER AS x FROM range(greatest(1, {height} // 2)) AS Y(t), range(32) AS X(t)),
level AS (SELECT c.y, c.x, sum(s.v * a.w * b.w) / sum(a.w * b.w) AS v FROM cells c, taps a, taps b, raster s WHERE s.y = 2 * c.y + a.o AND s.x = 2 * c.x + b.o GROUP BY c.y, c.x)"""


_BOX, _TENT = "(0, 1.0), (1, 1.0)", "(0, 0.5), (1, 1.0), (2, 0.5)"
_LANCZOS = "(-1, k(1.5)), (0, k(0.5)), (1, k(0.5)), (2, k(1.5))"
for _d in ("1.5", "0.5"):
    _LANCZOS = _LANCZOS.replace(f"k({_d})", f"2 * sin(pi() * {_d}) * sin(pi() * {_d} / 2) / (pi() * pi() * {_d} * {_d})")


def _cascade_up(levels: int) -> str:
    """Levels one from another, each halving by a mean and rounding up, as long as the level before has more than one cell."""
    steps = [f"l{k} AS (SELECT y // 2 AS y, (x // 2)::INTEGER AS x, avg(v) AS v FROM {'raster' if k == 1 else f'l{k - 1}'} GROUP BY ALL)" for k in range(1, levels)]
    return f"WITH {RASTER}, " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {k} AS level, y, x, round(v, 6) AS v FROM {'raster' if k == 0 else f'l{k}'} WHERE {k} = 0 OR (1 << {max(0, k - 1)}) < greatest(64, {H})" for k in range(levels))


def _rip() -> str:
    """Each cell is the mean of the block it stands for: sizes round down, so that blocks are whole."""
    return f"""WITH {RASTER}, levels AS (SELECT lx::INTEGER AS lx, ly::INTEGER AS ly, 1::BIGINT << lx AS w, 1::BIGINT << ly AS h FROM range(7) AS a(lx), range(40) AS b(ly) WHERE (1::BIGINT << ly) <= {H})
SELECT lx, ly, y // h AS y, (x // w)::INTEGER AS x, round(avg(v), 6) AS v FROM raster, levels WHERE x // w < greatest(1, 64 // w) AND y // h < {H} // h GROUP BY ALL"""


def _half(v: str) -> str:
    """Rounding to binary16 by arithmetic: the unit is a power of two by the exponent."""
    e = f"greatest(floor(log2(greatest(abs({v}), 1e-30))), -14)"
    return f"(CASE WHEN {v} = 0 THEN 0.0 ELSE round_even({v} * pow(2, 10 - {e}), 0) / pow(2, 10 - {e}) END)"


_YC = "0.2126 * r + 0.7152 * g + 0.0722 * b"
ORACLES |= {
    "p1_box_level": f"WITH {_level(RASTER, _BOX)} SELECT y, x, round(v, 6) AS v FROM level",
    "p2_triangle_level": f"WITH {_level(RASTER, _TENT)} SELECT y, x, round(v, 6) AS v FROM level",
    "p3_lanczos_level": f"WITH {_level(RASTER, _LANCZOS)} SELECT y, x, round(v, 6) AS v FROM level",
    "p6_clamped_level": f"WITH {_level(RASTER, _BOX)} SELECT y, x, round(greatest(v, 0), 6) AS v FROM level",
    "p7_half_level": f"WITH {_level(RASTER, _BOX)}, f AS (SELECT y, x, v::FLOAT::DOUBLE AS v FROM level) SELECT y, x, round({_half('v')}, 9) AS v FROM f",
    "p4_mip_pyramid_up": _cascade_up(16),
    "p5_rip_pyramid": _rip(),
    "p9_retile": f"WITH {RASTER} SELECT (x // 16)::INTEGER AS tx, (y // 32)::INTEGER AS ty, count(*) AS n, round(sum(v), 6) AS s, min(y) AS y0 FROM raster GROUP BY 1, 2",
    "p8_filters_by_channel": f"""WITH {RGBA}, long AS (UNPIVOT rgba ON r, g, b, a INTO NAME channel VALUE v),
taps(f, o, w) AS (VALUES {', '.join(f"('{n}', {t[1:]}" for n, ts in (('box', _BOX), ('tri', _TENT)) for t in ts.split(', (') for t in [t if t.startswith('(') else '(' + t])}, {', '.join("('lan', " + t.lstrip('(') for t in _LANCZOS.split(', (') )}),
kinds(channel, f) AS (VALUES ('r', 'tri'), ('g', 'box'), ('b', 'box'), ('a', 'lan')),
cells AS (SELECT Y.t AS y, X.t::INTEGER AS x FROM range((SELECT greatest(1, count(*) // 2) FROM embeddings)) AS Y(t), range(8) AS X(t)),
sums AS (SELECT s.channel, c.y, c.x, sum(s.v * a.w * b.w) / sum(a.w * b.w) AS v FROM cells c, kinds k, taps a, taps b, long s
  WHERE k.f = a.f AND a.f = b.f AND s.channel = k.channel AND s.y = 2 * c.y + a.o AND s.x = 2 * c.x + b.o GROUP BY ALL)
SELECT channel, y, x, round(v, 6) AS v FROM sums""",
    "a1_typed_get": f"WITH {RASTER} SELECT y, x, greatest(0, floor(v * 1000))::BIGINT AS u, round({_half('v')}, 9) AS h FROM raster",
    "a2_coverage": f"WITH {RGBA} SELECT 'b' AS channel, 3 AS x0, 0::BIGINT AS y0, 15 AS x1, max(y) AS y1 FROM rgba WHERE x > 2",
    "a3_allocated_grid": "SELECT y, x::INTEGER AS x, 0.0::DOUBLE AS v FROM range(-2, 61) AS a(y), range(-3, 41) AS b(x)",
    "a4d_aces_rules": f"WITH {HEADERS} SELECT id, 'error' AS severity, unnest(list_filter([CASE WHEN compression NOT IN (0, 4, 7) THEN 'compression' END, CASE WHEN tiled THEN 'tiled' END, CASE WHEN deep THEN 'deep' END], lambda s: s IS NOT NULL)) AS rule FROM headers",
    "a5_luminance_chroma": f"WITH {RGBA}, q AS (SELECT *, {_YC} AS l FROM rgba) SELECT y AS row, x, round(l, 6) AS lum, round(r / l - 1, 6) AS ry, round(b / l - 1, 6) AS by, round(g, 6) AS g FROM q",
    "a5c_chroma_subsample": f"WITH {RGBA}, q AS (SELECT *, {_YC} AS l FROM rgba) SELECT y // 2 AS cy, (x // 2)::INTEGER AS cx, round(avg(r / l - 1), 6) AS ry, round(avg(b / l - 1), 6) AS by FROM q GROUP BY 1, 2",
    "a6_chroma_upsample": f"""WITH {RGBA}, q AS (SELECT *, {_YC} AS l FROM rgba), c AS (SELECT y // 2 AS cy, x // 2 AS cx, avg(r / l - 1) AS ry, avg(b / l - 1) AS by FROM q GROUP BY 1, 2),
p AS (SELECT y, x, y // 2 AS y0, least(y // 2 + 1, ({H} + 1) // 2 - 1) AS y1, x // 2 AS x0, least(x // 2 + 1, 7) AS x1, (y % 2) / 2 AS fy, (x % 2) / 2 AS fx FROM (SELECT unnest(range({H})) AS y), range(16) AS b(x))
SELECT p.y, p.x, round((a.ry * (1 - fx) + b.ry * fx) * (1 - fy) + (d.ry * (1 - fx) + e.ry * fx) * fy, 6) AS ry, round((a.by * (1 - fx) + b.by * fx) * (1 - fy) + (d.by * (1 - fx) + e.by * fx) * fy, 6) AS by
FROM p JOIN c a ON a.cy = y0 AND a.cx = x0 JOIN c b ON b.cy = y0 AND b.cx = x1 JOIN c d ON d.cy = y1 AND d.cx = x0 JOIN c e ON e.cy = y1 AND e.cx = x1""",
    "a6b_yc_kind": f"WITH {CHANNELS}, n AS (SELECT id % 50 AS image, list(DISTINCT string_split(channel, '.')[-1]) AS names FROM channels GROUP BY 1) SELECT image, list_has_all(names, ['R', 'G', 'B']) AS rgb, list_contains(names, 'A') AS alpha, list_contains(names, 'Z') AND NOT list_contains(names, 'R') AS depth_only FROM n",
    "a7_preview": f"""WITH {RGBA}, size AS (SELECT {H} AS h, greatest(1, floor(16 * least(10 / 16, 30 / {H})))::INTEGER AS pw, greatest(1, floor({H} * least(10 / 16, 30 / {H})))::INTEGER AS ph),
cells AS (SELECT py::INTEGER AS py, px::INTEGER AS px, ph, pw FROM (SELECT ph, pw, unnest(range(ph)) AS py FROM size), range(16) AS b(px) WHERE px < pw),
m AS (SELECT py, px, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM cells, rgba
  WHERE y >= floor(py * ({H} / ph)) AND y < ceil((py + 1) * ({H} / ph)) AND x >= floor(px * (16 / pw)) AND x < ceil((px + 1) * (16 / pw)) GROUP BY 1, 2),
s AS (SELECT py, px, a, r / (1 + r) AS r, g / (1 + g) AS g, b / (1 + b) AS b FROM m)
SELECT py, px, floor((1.055 * pow(r, 1 / 2.4) - 0.055) * 255 + 0.5)::INTEGER AS r, floor((1.055 * pow(g, 1 / 2.4) - 0.055) * 255 + 0.5)::INTEGER AS g,
  floor((1.055 * pow(b, 1 / 2.4) - 0.055) * 255 + 0.5)::INTEGER AS b, least(255, floor(a * 255 + 0.5))::INTEGER AS a FROM s""",
    "a7c_tone_and_gamma": f"""WITH {RASTER}, q AS (SELECT y, x, v * 3 AS v FROM raster)
SELECT y, x, round(CASE WHEN v > 0 THEN 1 - 1 / (1 + v) ELSE 0 END, 6) AS tone,
  round(CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN 1 WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * exp(ln(v) / 2.4) - 0.055 END, 6) AS srgb,
  round(CASE WHEN abs(v) <= 0.04045 THEN abs(v) / 12.92 ELSE pow((abs(v) + 0.055) / 1.055, 2.4) END, 6) AS lin, greatest(0, least(255, floor(v * 255 + 0.5)))::INTEGER AS byte FROM q""",
    "h2_from_half": """WITH b AS (SELECT range::INTEGER AS bits, range // 1024 % 32 AS e, range % 1024 AS m, range >= 32768 AS neg FROM range(65536))
SELECT bits, CASE WHEN e = 31 THEN CASE WHEN m > 0 THEN 'nan' ELSE 'infinite' END WHEN e = 0 THEN CASE WHEN m = 0 THEN 'zero' ELSE 'subnormal' END ELSE 'normal' END AS kind,
  CASE WHEN e < 31 THEN CASE WHEN neg THEN -1 ELSE 1 END * CASE WHEN e = 0 THEN m ELSE (1024 + m) * (1::BIGINT << (e - 1)) END END AS units FROM b""",
    "h5_signs": """WITH b AS (SELECT range AS bits, range // 1024 % 32 AS e, range % 1024 AS m FROM range(65536))
SELECT CASE WHEN e = 31 THEN CASE WHEN m > 0 THEN 'nan' ELSE 'infinite' END WHEN e = 0 THEN CASE WHEN m = 0 THEN 'zero' ELSE 'subnormal' END ELSE 'normal' END AS kind, bits >= 32768 AS negative,
  count(*) AS n, max(bits % 32768)::INTEGER AS most, min((bits + 32768) % 65536)::INTEGER AS least_negated FROM b GROUP BY 1, 2""",
    "h4_compare": f"WITH {RGBA} SELECT x, count(*) FILTER (WHERE r < g) AS less, count(*) AS same FROM rgba GROUP BY x",
    "h1_to_half": f"""WITH {RASTER}, q AS (SELECT y, x, v * pow(10.0, x % 9 - 5) AS v FROM raster), r AS (SELECT y, x, v, {_half('v')} AS h FROM q), e AS (SELECT *, greatest(floor(log2(greatest(abs(h), 1e-30))), -14) AS e FROM r)
SELECT y, x, (CASE WHEN v < 0 THEN 32768 ELSE 0 END + CASE WHEN abs(h) < pow(2, -14) THEN abs(h) * pow(2, 24) ELSE (e + 14) * 1024 + abs(h) * pow(2, 10 - e) END)::INTEGER AS bits FROM e""",
}
ORACLES["p4_mip_pyramid"] = f"""WITH {RASTER}, dims AS (SELECT max(y) + 1 AS h FROM raster),
lv AS (SELECT l, greatest(1, 64 >> l) AS w, greatest(1, h >> l) AS h FROM dims, range(20) AS t(l) WHERE l <= floor(log2(h))),
xw AS (SELECT l, x, least(x >> l, w - 1) AS cx, 1.0 / (1 << least(l, 6)) AS wx FROM lv, range(64) AS t(x)),
yw AS (SELECT l, y, y >> l AS cy, 1.0 / (1 << l) AS wy FROM lv, (SELECT DISTINCT y FROM raster) WHERE y >> l < lv.h)
SELECT l::INTEGER AS level, cy AS y, cx::INTEGER AS x, round(sum(v * wx * wy), 6) AS v FROM raster JOIN xw USING (x) JOIN yw USING (l, y) GROUP BY 1, 2, 3"""

_NAMES = """parsed AS (SELECT id, channel, string_split(channel, '.') AS p, CASE WHEN len(p) = 2 AND p[1] IN ('left', 'right') THEN p[1] WHEN len(p) > 2 AND p[len(p) - 1] IN ('left', 'right') THEN p[len(p) - 1] ELSE '' END AS vw FROM channels),
named AS (SELECT *, p[len(p)] AS base, array_to_string(p[1:CASE WHEN vw = '' THEN len(p) - 1 ELSE len(p) - 2 END], '.') AS layer FROM parsed)"""
ORACLES |= {
    "m1_attributes": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS names, len(json_keys(props)) AS n FROM events",
    "m2_layers": f"WITH {CHANNELS} SELECT id, channel, CASE WHEN contains(channel, '.') THEN left(channel, length(channel) - length(string_split(channel, '.')[-1]) - 1) ELSE '' END AS layer, string_split(channel, '.')[-1] AS base FROM channels",
    "m2b_channels_by_layer": f"WITH {CHANNELS} SELECT CASE WHEN contains(channel, '.') THEN regexp_replace(channel, '\\.[^.]*$', '') ELSE '' END AS layer, array_to_string(list_sort(list(DISTINCT string_split(channel, '.')[-1])), ',') AS bases FROM channels GROUP BY 1",
    "m2f_bytes_per_pixel": f"WITH {HEADERS} SELECT id, [2, 6, 10, 12, 16][id % 5 + 1] AS bytes FROM headers",
    "m3_typed_metadata": f"WITH {HEADERS} SELECT id, CASE WHEN id % 12 <> 0 THEN (CASE WHEN id % 3 <> 0 THEN id * 0.25 ELSE 0 END)::DECIMAL(18, 2)::VARCHAR || '/' || (CASE WHEN id % 4 <> 0 THEN id * 0.5 ELSE 0 END)::DECIMAL(18, 2)::VARCHAR END AS geo FROM headers",
    "m4_rationals": "SELECT p_partkey, round(round(p_retailprice / 37, 4), 6) AS v, TRUE AS near, TRUE AS bounded FROM part",
    "m4b_rates": f"""WITH {HEADERS}, r(k, num, den, name) AS (VALUES (0, 24000, 1001, '23.976 fps (NTSC Film)'), (1, 24, 1, '24 fps (Cinema)'), (2, 25, 1, '25 fps (PAL)'), (3, 30000, 1001, '29.97 fps (NTSC)'), (4, 60000, 1001, '59.94 fps (NTSC HFR)'), (5, 25, 2, ''), (6, 0, 1, ''))
SELECT id, num::BIGINT AS num, den::BIGINT AS den, den = 1001 AS drop, r.name AS name FROM headers JOIN r ON id % 7 = k""",
    "m5_timecodes": """WITH t AS (SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts)::BIGINT AS s, floor((microsecond(ts) % 1000000) * 24 / 1000000)::BIGINT AS f, CASE WHEN event_id % 2 = 0 THEN 64 ELSE 0 END AS d FROM events),
p AS (SELECT *, ('0x' || printf('%02d%02d%02d%02d', h, m, s, f))::BIGINT + d AS packed FROM t)
SELECT event_id, packed, f::INTEGER AS frames, s::INTEGER AS seconds, m::INTEGER AS minutes, h::INTEGER AS hours, packed - d AS film FROM p""",
    "m7_copied_metadata": "SELECT event_id, array_to_string(list_sort(list_append(json_keys(props), 'owner')), ',') AS names FROM events",
    "v1_parse_views": f"WITH {CHANNELS}, {_NAMES} SELECT id, layer, vw, base FROM named",
    "v2_build_names": f"WITH {CHANNELS} SELECT id, channel AS built, TRUE AS same FROM channels",
    "v3_view_lists": f"WITH {CHANNELS}, {_NAMES}, l AS (SELECT id % 40 AS id, list_sort(list(DISTINCT vw)) AS views FROM named WHERE vw <> '' GROUP BY 1) SELECT id, array_to_string(views, ',') AS views, views[1] AS default_view, len(views) = 2 AS stereo FROM l",
    "v5_channels_of_view": f"WITH {CHANNELS}, {_NAMES} SELECT id, channel FROM named WHERE vw IN ('left', '')",
    "v7_merge_views": f"""WITH {RGBA}, l AS (SELECT * FROM rgba WHERE x < 10), r AS (SELECT * FROM rgba WHERE x > 5), cells AS (SELECT y, x FROM rgba)
SELECT y, x, round(coalesce(l.r, 0), 6) AS "left.r", round(coalesce(l.a, 0), 6) AS "left.a", round(coalesce(r.r, 0), 6) AS "right.r", round(coalesce(r.a, 0), 6) AS "right.a" FROM cells LEFT JOIN l USING (y, x) LEFT JOIN r USING (y, x)""",
    "v8_combine_parts": f"""WITH {HEADERS}, u AS (SELECT 0 AS f, id AS part, 'p' || id % 100 AS name, w, NULL::INTEGER AS h FROM headers WHERE id <= (SELECT count(*) // 2 FROM part) UNION ALL SELECT 1, id, 'p' || id % 70, NULL, h FROM headers WHERE id > (SELECT count(*) // 2 FROM part)),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f, part) - 1 AS k FROM u) SELECT part, name || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS name, w, h FROM n""",
    "e1_directions": f"""WITH {RASTER}, q AS (SELECT y, x, -pi() * (y / ({H} - 1) - 0.5) AS lat, -2 * pi() * (x / 63 - 0.5) AS lon FROM raster)
SELECT y, x, round(sin(lon) * cos(lat), 6) AS dx, round(sin(lat), 6) AS dy, round(cos(lon) * cos(lat), 6) AS dz, CASE WHEN y > 0 AND y < {H} - 1 AND x > 0 AND x < 63 THEN x::DOUBLE END AS px, y::DOUBLE AS py FROM q""",
    "e3_cube_faces": f"""WITH {RASTER}, q AS (SELECT y, x, v AS a, x / 64 - 0.5001 AS b, y / rows - 0.4999 AS c, greatest(abs(a), abs(b), abs(c)) AS n FROM raster, (SELECT count(*) AS rows FROM embeddings)),
f AS (SELECT *, CASE WHEN abs(a) = n THEN CASE WHEN a > 0 THEN 0 ELSE 1 END WHEN abs(b) = n THEN CASE WHEN b > 0 THEN 2 ELSE 3 END ELSE CASE WHEN c > 0 THEN 4 ELSE 5 END END AS face FROM q),
p AS (SELECT *, 4 * (CASE WHEN face < 2 THEN b ELSE a END / n + 1) AS u, 4 * (CASE WHEN face < 4 THEN c ELSE b END / n + 1) AS v FROM f)
SELECT y, x, face, round(u, 6) AS u, round(v, 6) AS v, round([v, 8 - v, u, u, 8 - u, u][face + 1], 6) AS px, round([8 - u, 8 - u, 8 - v, v, 8 - v, 8 - v][face + 1] + 9 * face, 6) AS py FROM p""",
    "e5_bilinear": f"""WITH {RASTER}, {RGBA}, p AS (SELECT y, x, v * 40 AS px, x * 1.3 + y * 0.2 AS py FROM raster),
q AS (SELECT *, px - floor(px) AS fx, py - floor(py) AS fy, greatest(0, least(15, floor(px))) AS x0, greatest(0, least(15, floor(px) + 1)) AS x1, greatest(0, least({H} - 1, floor(py))) AS y0, greatest(0, least({H} - 1, floor(py) + 1)) AS y1 FROM p)
SELECT q.y, q.x, """
    + ", ".join(f"round((1 - fx) * (1 - fy) * i.{c} + fx * (1 - fy) * j.{c} + (1 - fx) * fy * k.{c} + fx * fy * l.{c}, 6) AS {c}" for c in "rgba")
    + " FROM q JOIN rgba i ON i.x = x0 AND i.y = y0 JOIN rgba j ON j.x = x1 AND j.y = y0 JOIN rgba k ON k.x = x0 AND k.y = y1 JOIN rgba l ON l.x = x1 AND l.y = y1",
    "e10_inferred_kind": f"WITH {HEADERS} SELECT id, CASE WHEN id % 11 = 0 THEN 'cube' WHEN id % 13 = 0 THEN 'latlong' WHEN id % 3 = 0 OR h = 6 * w THEN 'cube' ELSE 'latlong' END AS kind FROM headers",
    "e11_padded": f"WITH {RGBA}, g AS (SELECT y, x::INTEGER AS x FROM (SELECT unnest(range({H} + 5)) AS y), range(16) AS b(x)) SELECT g.y, g.x, round(coalesce(r, 0), 6) AS r, round(coalesce(g_, 0), 6) AS g, round(coalesce(b, 0), 6) AS b, round(coalesce(a, 0), 6) AS a FROM g LEFT JOIN (SELECT y, x, r, g AS g_, b, a FROM rgba) s ON s.y = g.y - 3 AND s.x = g.x",
    "e9_diffuse_blur": f"""WITH {RGBA}, cells AS (SELECT i // 8 AS y, (i % 8)::INTEGER AS x, i // 64 AS f, i // 8 % 8 AS u, i % 8 AS v, u / 3.5 - 1 AS p, v / 3.5 - 1 AS q, CASE WHEN f % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM range(384) AS t(i)),
d AS (SELECT y, x, sqrt(1 + p * p + q * q) AS n, CASE WHEN f < 2 THEN s ELSE p END / n AS dx, CASE WHEN f < 2 THEN p WHEN f < 4 THEN s ELSE q END / n AS dy, CASE WHEN f < 4 THEN q ELSE s END / n AS dz,
  1 / (n * n * n) / CASE (u IN (0, 7))::INTEGER + (v IN (0, 7))::INTEGER WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS w FROM cells),
m AS (SELECT d.*, r, g, b, a FROM d JOIN rgba USING (y, x)),
c AS (SELECT t.y, t.x, (t.dx * m.dx + t.dy * m.dy + t.dz * m.dz) * m.w AS k, r, g, b, a FROM d t, m WHERE t.dx * m.dx + t.dy * m.dy + t.dz * m.dz > 0)
SELECT y, x, round(sum(k * r) / sum(k), 6) AS r, round(sum(k * g) / sum(k), 6) AS g, round(sum(k * b) / sum(k), 6) AS b, round(sum(k * a) / sum(k), 6) AS a FROM c GROUP BY y, x""",
    "i5_lookup": "SELECT p_name AS name, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "i6_group_of_channel": f"WITH {CHANNELS}, g AS (SELECT id % 20 AS idx, list(DISTINCT channel) AS c FROM channels GROUP BY 1) SELECT idx, len(c) AS n FROM g WHERE list_contains(c, 'left.B') ORDER BY idx LIMIT 1",
    "i7_manifest_json": "SELECT p_partkey % 10 AS manifest, p_name || '_' || p_partkey AS name, p_partkey * 2654435 % 4294967296 AS id FROM part",
    "i9_channel_sets": "SELECT n_name, n_name || printf('%02d', k) || '.' || c AS channel FROM nation, range(3) AS a(k), (SELECT unnest(['R', 'G', 'B', 'A']) AS c)",
    "q1_file_info": f"""WITH {HEADERS} SELECT id, name, w, h, min_x + w - 1 AS max_x, min_y + h - 1 AS max_y, compression, compression BETWEEN 5 AND 9 AS lossy, tiled, deep, mode,
CASE WHEN tiled THEN ceil(w / tw) * ceil(h / th) ELSE ceil(h / CASE WHEN compression IN (3, 5) THEN 16 WHEN compression IN (4, 6, 7, 8, 11) THEN 32 WHEN compression IN (9, 10) THEN 256 ELSE 1 END) END::BIGINT AS chunks FROM headers""",
    "q2_compare": f"""WITH {RGBA}, long AS (UNPIVOT rgba ON r, g, b, a INTO NAME channel VALUE v), d AS (SELECT channel, CASE WHEN y <> 7 THEN CASE WHEN channel = 'g' THEN abs(v - round(v, 2)) ELSE 0 END END AS e FROM long)
SELECT channel, count(*) FILTER (WHERE e IS NULL OR e > 0.002) AS n_diff, round(max(e) FILTER (WHERE e > 0.002), 6) AS max_diff FROM d GROUP BY channel""",
    "q2_channel_difference": f"WITH {CHANNELS}, c AS (SELECT DISTINCT channel FROM channels) SELECT channel, CASE WHEN channel LIKE '%.R' THEN 'second' ELSE 'first' END AS side FROM c WHERE (channel LIKE '%.R') <> (channel LIKE 'left%') AND TRUE",
    "q3_validate": f"""WITH {HEADERS} SELECT id, s AS severity, r AS rule FROM headers, LATERAL (VALUES
('error', 'deep data allow no, run-length or single-line deflate compression only', deep AND compression > 2), ('error', 'levels need tiles', NOT tiled AND mode <> 'one'), ('error', 'unknown compression', compression > 11),
('warning', 'larger than 32768', w > 32768 OR h > 32768), ('warning', 'lossy compression', compression BETWEEN 5 AND 9), ('warning', 'window does not start at 0', min_x <> 0 OR min_y <> 0)) AS v(s, r, ok) WHERE ok""",
    "q4_chunk_rules": _CAT.replace("%s", "p_partkey % 3 = 0") + """, dam AS (SELECT id, idx, CASE WHEN idx = 5 THEN 0 ELSE place END AS o, CASE WHEN idx = 7 THEN 0 ELSE length END AS l FROM chunks)
SELECT id, 'offset comes twice' AS rule, 2 AS n FROM dam WHERE idx = 5 UNION ALL SELECT id, 'empty chunk', 1 FROM dam WHERE idx = 7 UNION ALL SELECT id, 'chunk ends past the file', count(*) FROM dam WHERE o + l > 200000 GROUP BY id""",
    "q7_metrics": "SELECT l_returnflag, round(median(l_extendedprice), 6) AS median, count(*) AS n FROM lineitem GROUP BY 1",
}


def _aces() -> str:
    """The nine numbers come from the operator; tests hold them against published ones."""
    from rasterweave.functions.colour import to_aces

    m = to_aces()
    terms = [" + ".join(f"{float(k)!r} * {c}" for k, c in zip(row, "rgb", strict=True)) for row in m]
    return f"WITH {RGBA} SELECT y, x, round({terms[0]}, 6) AS r, round({terms[1]}, 6) AS g, round({terms[2]}, 6) AS b FROM rgba"


ORACLES["a4_aces_conversion"] = _aces()
ORACLES["h6_vectors"] = f"""WITH e AS (SELECT vec_id, unnest(range(64))::INTEGER AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT vec_id, i, {_half('(v * 2)')} AS p, greatest(least(v * 1e6, 65504.0), -65504.0) AS q FROM e), t AS (SELECT vec_id, i, p + (q - p) * 0.25 AS v FROM s)
SELECT vec_id, i, round({_half('v')}, 6) AS v FROM t"""

ORACLES |= {
    "m2d_channel_sorts": f"""WITH {CHANNELS}, c AS (SELECT id % 30 AS image, list_sort(list(DISTINCT channel)) AS names FROM channels GROUP BY 1)
SELECT image, array_to_string(names, ',') AS names, array_to_string(list_filter(names, lambda n: regexp_matches(n, '^left\\.[^.]*$')), ',') AS in_left FROM c""",
    "m2e_has_channels": f"""WITH {CHANNELS}, c AS (SELECT id % 30 AS image, string_split(channel, '.')[-1] AS b FROM channels)
SELECT image, bool_or(b = 'R') AND bool_or(b = 'G') AND bool_or(b = 'B') AS rgb, bool_or(b = 'A') AS a, bool_or(b = 'R') AND bool_or(b = 'G') AND bool_or(b = 'B') AND bool_or(b = 'A') AS rgba FROM c GROUP BY image""",
    "v4_parts_by_view": f"WITH {CHANNELS}, {_NAMES} SELECT id % 40 AS image, vw, min(id) AS first, string_agg(id::VARCHAR, ',' ORDER BY id) AS parts FROM named WHERE vw <> '' GROUP BY 1, 2",
    "v9_separated_parts": f"WITH {HEADERS} SELECT id, name, kind FROM headers WHERE brand = 'Brand#12'",
    "e2_lat_long_pixels": f"WITH {RASTER} SELECT y, x, round(pi() / 2 - pi() * y / ({H} - 1), 6) AS lat, round(pi() - 2 * pi() * x / 63, 6) AS lon FROM raster",
    "e4_cube_pixels": """WITH g AS (SELECT y, x::INTEGER AS x, (y // 9)::INTEGER AS face, y % 9 AS r FROM range(54) AS a(y), range(9) AS b(x))
SELECT y, x, face, CASE face WHEN 0 THEN 8 - r WHEN 1 THEN 8 - r WHEN 4 THEN 8 - x ELSE x END::DOUBLE AS u, CASE face WHEN 0 THEN x WHEN 1 THEN 8 - x WHEN 3 THEN r ELSE 8 - r END::DOUBLE AS v, x::DOUBLE AS bx, y::DOUBLE AS by FROM g""",
    "e6_lookup": f"""WITH {RASTER}, {RGBA}, q AS (SELECT y, x, v AS a, x / 64 - 0.5003 AS b, y / rows - 0.4007 AS c, greatest(abs(a), abs(b), abs(c)) AS n FROM raster, (SELECT count(*) AS rows FROM embeddings)),
f AS (SELECT *, CASE WHEN abs(a) = n THEN CASE WHEN a > 0 THEN 0 ELSE 1 END WHEN abs(b) = n THEN CASE WHEN b > 0 THEN 2 ELSE 3 END ELSE CASE WHEN c > 0 THEN 4 ELSE 5 END END AS face FROM q),
p AS (SELECT *, 3.5 * (CASE WHEN face < 2 THEN b ELSE a END / n + 1) AS u, 3.5 * (CASE WHEN face < 4 THEN c ELSE b END / n + 1) AS v FROM f),
s AS (SELECT y, x, [v, 7 - v, u, u, 7 - u, u][face + 1] AS px, [7 - u, 7 - u, 7 - v, v, 7 - v, 7 - v][face + 1] + 8 * face AS py FROM p),
w AS (SELECT *, px - floor(px) AS fx, py - floor(py) AS fy, greatest(0, least(7, floor(px))) AS x0, greatest(0, least(7, floor(px) + 1)) AS x1, greatest(0, least(47, floor(py))) AS y0, greatest(0, least(47, floor(py) + 1)) AS y1 FROM s)
SELECT w.y, w.x, """
    + ", ".join(f"round((1 - fx) * (1 - fy) * i.{c} + fx * (1 - fy) * j.{c} + (1 - fx) * fy * k.{c} + fx * fy * l.{c}, 6) AS {c}" for c in "rgba")
    + " FROM w JOIN rgba i ON i.x = x0 AND i.y = y0 JOIN rgba j ON j.x = x1 AND j.y = y0 JOIN rgba k ON k.x = x0 AND k.y = y1 JOIN rgba l ON l.x = x1 AND l.y = y1",
    "i8_manifest_lines": """SELECT p_partkey % 7 AS manifest, '{' || string_agg('"' || n || '":"' || printf('%08x', p_partkey * 2654435 % 4294967296) || '"', ',' ORDER BY n) || '}' AS json
FROM (SELECT p_partkey, p_name || '_' || p_partkey AS n FROM part) GROUP BY 1""",
    "q5_structure": f"WITH {HEADERS} SELECT mode, tiled, deep, count(*) AS parts, sum(w::BIGINT * h)::BIGINT AS pixels, max(greatest(w, h)) AS largest FROM headers GROUP BY ALL",
}


def _filtered(directions: str, key: str, radius: float, rows: str) -> str:
    """Filtered lookups in a latlong map of 16 columns: each of 25 directions is sampled by itself, then averaged."""
    bilinear = ", ".join(f"(1 - fx) * (1 - fy) * i.{c} + fx * (1 - fy) * j.{c} + (1 - fx) * fy * k.{c} + fx * fy * l.{c} AS {c}" for c in "rgba")
    return f"""n AS (SELECT {key}, dx / m AS dx, dy / m AS dy, dz / m AS dz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS m FROM ({directions}))),
u AS (SELECT *, CASE WHEN abs(dx) > 0.707 THEN -dz ELSE dz END / sqrt(dz * dz + dy * dy) AS ay, CASE WHEN abs(dx) > 0.707 THEN dy ELSE -dy END / sqrt(dz * dz + dy * dy) AS az FROM n),
v AS (SELECT *, dy * az - dz * ay AS ex, -dx * az AS ey, dx * ay AS ez FROM u),
o AS (SELECT (s - 2) / 3 AS s, (t - 2) / 3 AS t FROM range(5) AS a(s), range(5) AS b(t)),
p AS (SELECT v.*, (1 - abs(s)) * (1 - abs(t)) AS w, dx + {radius} * t * ex AS qx, dy + {radius} * (s * ay + t * ey) AS qy, dz + {radius} * (s * az + t * ez) AS qz FROM v, o),
c AS (SELECT {key}, w, (0.5 - atan2(qx, qz) / (2 * pi())) * 15 AS px, (0.5 - asin(qy / sqrt(qx * qx + qy * qy + qz * qz)) / pi()) * ({rows} - 1) AS py FROM p),
g AS (SELECT *, px - floor(px) AS fx, py - floor(py) AS fy, greatest(0, least(15, floor(px))) AS x0, greatest(0, least(15, floor(px) + 1)) AS x1, greatest(0, least({rows} - 1, floor(py))) AS y0, greatest(0, least({rows} - 1, floor(py) + 1)) AS y1 FROM c),
h AS (SELECT {', '.join('g.' + k.strip() for k in key.split(','))}, w, {bilinear} FROM g JOIN rgba i ON i.x = x0 AND i.y = y0 JOIN rgba j ON j.x = x1 AND j.y = y0 JOIN rgba k ON k.x = x0 AND k.y = y1 JOIN rgba l ON l.x = x1 AND l.y = y1)
SELECT {key}, {", ".join(f"round(sum(w * {c}) / sum(w), 5) AS {c}" for c in "rgba")} FROM h GROUP BY {key}"""


ORACLES["e7_filtered_lookup"] = f"WITH {RASTER}, {RGBA}, " + _filtered("SELECT y, x, v AS dx, x / 64 - 0.5 AS dy, 0.3 AS dz FROM raster", "y, x", 0.4, "8")
ORACLES["e8_convert"] = f"""WITH {RGBA}, e AS (SELECT y, x::INTEGER AS x, y // 6 AS f, y % 6 AS r FROM range(36) AS a(y), range(6) AS b(x)),
uv AS (SELECT y, x, f, CASE WHEN f < 2 THEN 5 - r WHEN f = 4 THEN 5 - x ELSE x END / 2.5 - 1 AS p, CASE f WHEN 0 THEN x WHEN 1 THEN 5 - x WHEN 3 THEN r ELSE 5 - r END / 2.5 - 1 AS q, CASE WHEN f % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM e),
d AS (SELECT y, x, CASE WHEN f < 2 THEN s ELSE p END AS dx, CASE WHEN f < 2 THEN p WHEN f < 4 THEN s ELSE q END AS dy, CASE WHEN f < 4 THEN q ELSE s END AS dz FROM uv), """ + _filtered("SELECT * FROM d", "y, x", 0.25, H)


_SAMPLES = f"""px AS (SELECT 'Z' AS channel, y, x, round(v::FLOAT::DOUBLE, 6) AS v FROM raster UNION ALL SELECT 'A', y, x, round({_half('v')}, 6) FROM raster)"""
_ALL = f"WITH {RASTER}, {_SAMPLES} SELECT channel, y, x, v FROM px"
_BANDS = "bands AS (SELECT 'band' || printf('%05d', b) AS path, b * 40 AS y0, least(b * 40 + 40, n) - 1 AS y1 FROM (SELECT count(*) AS n FROM embeddings), range(1000) AS t(b) WHERE b * 40 < n)"
ORACLES |= {
    "s1_scanline_scan": _ALL,
    "c2_run_lengths": _ALL,
    "c5_wavelet": _ALL,
    "s1_scanline_scan_window": f"WITH {RASTER} SELECT 'Z' AS channel, y, x, round(v, 6) AS v FROM raster WHERE x BETWEEN 5 AND 20 AND y BETWEEN 30 AND 90",
    "s1b_tiled_scan": f"WITH {RASTER} SELECT 'band' || printf('%05d', y // 40) AS path, y // 40 * 40 + y % 40 // 4 AS y, (x // 4)::INTEGER AS x, round(v, 6) AS v FROM raster WHERE y % 40 % 4 = 0 AND x % 4 = 0",
    "s1c_deep_scan": f"WITH {RASTER} SELECT y, x, s::INTEGER AS sample, round(v, 6) AS z FROM raster, range(2) AS t(s) WHERE s < x % 3",
    "s4_byte_catalogue": f"WITH {_BANDS} SELECT path, (y - y0)::INTEGER AS idx, 64 * 6 AS length, y AS y0, y AS y1, 63 AS x1 FROM bands, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)",
    "s6_recovery_scan": f"WITH {RASTER}, {_SAMPLES.replace(', 6)', ', 12)')} SELECT channel, count(*) AS n, round(sum(v), 3) AS s FROM px GROUP BY channel",
    "s7_header_scan": f"""WITH {_BANDS} SELECT path, 0 AS part, name, type, bytes FROM bands, (VALUES ('channels', 'chlist', 37), ('compression', 'compression', 1), ('dataWindow', 'box2i', 16), ('displayWindow', 'box2i', 16),
  ('lineOrder', 'lineOrder', 1), ('pixelAspectRatio', 'float', 4), ('screenWindowCenter', 'v2f', 8), ('screenWindowWidth', 'float', 4)) AS a(name, type, bytes)""",
    "c6_24_bits": f"""WITH {RASTER}, e AS (SELECT y, x, v::FLOAT::DOUBLE AS v, floor(log2(abs(v::FLOAT::DOUBLE))) AS e FROM raster)
SELECT y, x, round(sign(v) * floor(abs(v) * pow(2, 15 - e) + 0.5) / pow(2, 15 - e), 9) AS v FROM e""",
}


def _murmur(rows: str, keep: str) -> str:
    """CTEs up to `hashed` ({keep}, h): MurmurHash3 of the bytes of s, seed 0, folded over 32-bit words in 128-bit arithmetic."""
    m, c1, c2 = "4294967295::HUGEINT", "3432918353::HUGEINT", "461845907::HUGEINT"
    rot = lambda v, n: f"((({v} << {n}) | ({v} >> {32 - n})) & {m})"
    scramble = lambda k: f"(({rot(f'(({k} * {c1}) & {m})', 15)} * {c2}) & {m})"
    final = lambda v, n, c: f"((xor({v}, {v} >> {n}) * {c}::HUGEINT) & {m})"
    return f"""src AS ({rows}),
bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::HUGEINT) AS b FROM src),
words AS (SELECT *, list_transform(range(len(b) // 4), lambda i: b[4*i+1] + b[4*i+2] * 256 + b[4*i+3] * 65536 + b[4*i+4] * 16777216) AS w, b[len(b) // 4 * 4 + 1:] AS t FROM bytes),
mixed AS (SELECT *, list_transform(w, lambda k: {scramble('k')}) AS ks, coalesce(t[1], 0) + coalesce(t[2], 0) * 256 + coalesce(t[3], 0) * 65536 AS tail FROM words),
folded AS (SELECT *, list_reduce(list_prepend(0::HUGEINT, ks), lambda h, k: ({rot('xor(h, k)', 13)} * 5 + 3864292196::HUGEINT) & {m}) AS h0 FROM mixed),
lengths AS (SELECT *, xor(xor(h0, {scramble('tail')}), len(b)::HUGEINT) AS h1 FROM folded),
first_step AS (SELECT *, {final('h1', 16, 2246822507)} AS h2 FROM lengths),
second_step AS (SELECT *, {final('h2', 13, 3266489909)} AS h3 FROM first_step),
hashed AS (SELECT {keep}, xor(h3, h3 >> 16)::BIGINT AS h FROM second_step)"""


ORACLES |= {
    "i1_murmur_ids": f"WITH {_murmur('SELECT DISTINCT p_name, p_name AS s FROM part', 'p_name')} SELECT p_name, h AS id FROM hashed",
    "i3_float_ids": f"WITH {_murmur('SELECT n_name, n_name AS s FROM nation', 'n_name')} SELECT n_name, CASE WHEN (h >> 23) & 255 IN (0, 255) THEN xor(h, 8388608) ELSE h END AS bits FROM hashed",
    "i4_manifest": f"WITH {_murmur('SELECT DISTINCT p_brand, p_type, p_brand || chr(0) || p_type AS s FROM part', 'p_brand, p_type')} SELECT h AS id, string_agg(p_brand || '|' || p_type, '|' ORDER BY p_brand, p_type) AS names FROM hashed GROUP BY h",
}


def _halves(columns: str) -> str:
    return ", ".join(f"round({_half(c)}, 6) AS {c}" for c in columns.split())


_PLANES = f"""q AS (SELECT *, {_YC} AS l FROM rgba), c AS (SELECT y // 2 * 2 AS y, (x // 2 * 2)::INTEGER AS x, avg(r / l - 1) AS cr, avg(b / l - 1) AS cb FROM q GROUP BY 1, 2)"""
_NAMED = "SELECT '%s' AS channel, y, x, round(%s, 6) AS v FROM %s"
ORACLES |= {
    "k1b_tiled_sink": f"WITH {RASTER} SELECT 'Z' AS channel, y, x, round(v::FLOAT::DOUBLE, 6) AS v FROM raster",
    "k2_rgba_sink": f"WITH {RGBA} SELECT y, x, {_halves('r g b a')} FROM rgba",
    "k5_luminance_chroma_sink": f"WITH {RGBA}, {_PLANES} " + " UNION ALL ".join(_NAMED % x for x in (("Y", _half("l"), "q"), ("RY", _half("cr"), "c"), ("BY", _half("cb"), "c"))),
    "a6c_luminance_read": f"WITH {RGBA}, q AS (SELECT *, {_YC} AS l FROM rgba) SELECT y, x, round({_half('l')}, 6) AS r, round({_half('l')}, 6) AS g, round({_half('l')}, 6) AS b, round({_half('a')}, 6) AS a FROM q",
    "k6_stereo_sink": f"WITH {RGBA} " + " UNION ALL ".join(_NAMED % x for x in (("R", _half("r"), "rgba"), ("right.R", _half("g"), "rgba"))),
    "k6_stereo_parts_sink": f"WITH {RGBA} " + " UNION ALL ".join(_NAMED % x for x in (("R", _half("g"), "rgba"), ("B", _half("b"), "rgba"))),
    "k8_line_order": f"SELECT k::INTEGER AS idx, ((n - 1) // 16 - k)::INTEGER AS place, k * 16 AS y0, least(k * 16 + 15, n - 1) AS y1 FROM (SELECT n, unnest(range((n - 1) // 16 + 1)) AS k FROM (SELECT {H} AS n))",
    "v10_converted": f"WITH {RGBA} " + _NAMED % ("R", _half("g"), "rgba"),
    "q6_recompressed": f"""WITH {RASTER}, f AS (SELECT printf('band%05d', y // 40) AS path, v FROM raster)
SELECT path, 'A' AS channel, count(*) AS n, round(sum({_half('v')}), 3) AS s, '04' AS compression FROM f GROUP BY path
UNION ALL SELECT path, 'Z', count(*), round(sum(v::FLOAT::DOUBLE), 3), '04' FROM f GROUP BY path""",
}


def _aces_halves() -> str:
    from rasterweave.functions.colour import to_aces

    terms = ["(" + " + ".join(f"{float(k)!r} * {c}" for k, c in zip(row, "rgb", strict=True)) + ")" for row in to_aces()]
    return f"WITH {RGBA}, q AS (SELECT y, x, {terms[0]} AS r, {terms[1]} AS g, {terms[2]} AS b FROM rgba) " + " UNION ALL ".join(_NAMED % (c.upper(), _half(c), "q") for c in "rgb")


ORACLES["k7_aces_sink"] = _aces_halves()
_PART = "printf('part%06d', p_partkey) AS path"
_LINEAR = "round(CASE WHEN %s / 255 <= 0.04045 THEN %s / 255 / 12.92 ELSE pow((%s / 255 + 0.055) / 1.055, 2.4) END, 6)"
ORACLES |= {
    "m3_typed_metadata": f"""SELECT {_PART}, p_name AS owner, p_partkey::INTEGER AS counter, '24000/1001' AS rate, NULL::VARCHAR AS "reelName", p_size * 100.0::DOUBLE AS "isoSpeed", round(p_retailprice::FLOAT::DOUBLE, 6) AS focus,
NULL::DOUBLE AS aperture, p_brand AS "cameraMake", p_size::DOUBLE AS balance, p_partkey::DOUBLE AS "right" FROM part""",
    "m3_locations": f"""SELECT {_PART}, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey * 0.5 ELSE 0 END::DOUBLE AS longitude, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 0.25 ELSE 0 END::DOUBLE AS latitude, NULL::DOUBLE AS altitude
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0 AND p_partkey % 5 <> 0""",
    "m8_header_dump": f"""SELECT {_PART}, unnest(list_filter(['channels (chlist): Z:float', 'compression (compression): 0', 'dataWindow (box2i): 0 0 0 0', 'displayWindow (box2i): 0 0 0 0', 'lineOrder (lineOrder): 0', 'pixelAspectRatio (float): 1',
'screenWindowCenter (v2f): 0 0', 'screenWindowWidth (float): 1', 'owner (string): ' || p_name, 'imageCounter (int): ' || p_partkey, 'framesPerSecond (rational): 24000 1001', 'isoSpeed (float): ' || p_size * 100, 'cameraMake (string): ' || p_brand,
'cameraColorBalance (v2f): ' || p_size || ' 0.5', 'sensorAcquisitionRectangle (box2i): 0 0 ' || p_partkey || ' ' || p_size, 'worldToNDC (m44f): ' || array_to_string(range(16), ' '), 'preview (preview): ?',
CASE WHEN p_partkey % 3 <> 0 THEN 'latitude (float): ' || regexp_replace((p_partkey * 0.25)::DECIMAL(18, 2)::VARCHAR, '\\.?0+$', '') END,
CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'longitude (int): ' || p_partkey ELSE 'longitude (float): ' || regexp_replace((p_partkey * 0.5)::DECIMAL(18, 1)::VARCHAR, '\\.0+$', '') END END], lambda s: s IS NOT NULL)) AS line FROM part""",
    "m6_header_rules": f"""SELECT {_PART}, CASE p_partkey % 10 WHEN 8 THEN 'window is empty' WHEN 9 THEN 'sampling below one'
ELSE 'no ' || ['channels', 'compression', 'dataWindow', 'displayWindow', 'lineOrder', 'pixelAspectRatio', 'screenWindowCenter', 'screenWindowWidth'][p_partkey % 10 + 1] END AS rule FROM part""",
    "a7d_preview_decode": f"""WITH p AS (SELECT {_PART}, unnest([0, 1])::INTEGER AS x, unnest([p_partkey % 256, 255]) AS r, unnest([p_size, 10]) AS g, unnest([0, p_partkey % 7]) AS b, unnest([255, 51]) AS a FROM part)
SELECT path, 0::INTEGER AS y, x, {', '.join(_LINEAR % (c, c, c) + f' AS {c}' for c in 'rgb')}, round(a / 255, 6) AS a FROM p""",
    "q4_file_problems": f"""WITH b AS (SELECT k, printf('band%05d', k) AS path, least(40, {H} - k * 40) AS rows FROM (SELECT unnest(range(({H} - 1) // 40 + 1)) AS k))
SELECT path, (rows - 1)::INTEGER AS idx, 'a chunk''s head is cut' AS rule FROM b WHERE k % 4 = 1 UNION ALL SELECT path, 1, 'no place in the file' FROM b WHERE k % 4 = 2
UNION ALL SELECT path, 3, 'place comes twice' FROM b WHERE k % 4 = 2 UNION ALL SELECT path, 4, 'holds another chunk' FROM b WHERE k % 4 = 3""",
    "v6_read_view": f"WITH {RGBA} SELECT y, x, round({_half('g')}, 6) AS r, round({_half('g')}, 6) AS g, round({_half('b')}, 6) AS b, round({_half('a')}, 6) AS a FROM rgba",
}
_FLAT = f"WITH {RASTER} SELECT 'A' AS channel, y + k // 4 AS y, (x + k % 4)::INTEGER AS x, round({_half('v')}, 6) AS v FROM raster, range(16) AS t(k) WHERE y % 4 = 0 AND x % 4 = 0"
ORACLES |= {
    "i10_binary_manifest": ORACLES["i7_manifest_json"],
    "c7_flat_blocks": _FLAT,
    "c8_flat_blocks": _FLAT,
    # fixed values: published results of the hash
    "i2_murmur_128_vectors": """SELECT * FROM (VALUES ('', '0000000000000000'), ('hello', 'cbd8a7b341bd9b02'), ('hello, world', '342fac623a5ebc8e'), ('The quick brown fox jumps over the lazy dog', 'e34bbc7bbc071b6c')) AS t(text, id)""",
}
