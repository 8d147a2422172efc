"""Plain SQL for the registered queries: the same figures by box arithmetic, without any geometry code."""

from __future__ import annotations

M2 = "(111000.0::DOUBLE * 111000.0::DOUBLE)"
FACTOR_2188 = f"({M2} * cos(radians(-21.88::DOUBLE)))"

# Footprints as disjoint boxes; areas of interest as disjoint boxes; their overlaps per pair.
WORLD = f"""
fp AS (
  SELECT o_orderkey AS id, o_custkey AS custkey,
         CASE WHEN o_orderstatus = 'P' THEN 'microsoft' ELSE 'google' END AS bf_source,
         sqrt(o_totalprice) / 20::DOUBLE / 111000::DOUBLE AS side,
         (-45.4::DOUBLE + ((o_orderkey // 7500) % 400) * 0.25::DOUBLE) + (o_orderkey % 100) * 0.002::DOUBLE AS x0,
         (-21.95::DOUBLE + ((o_orderkey // 7500 // 400) % 300) * 0.2::DOUBLE)
           + ((o_orderkey // 100) % 75) * 0.002::DOUBLE AS y0
  FROM orders),
fp_shape AS (
  SELECT *, CASE WHEN id % 4 = 3 THEN 'corner' WHEN id % 16 = 1 THEN 'courtyard' WHEN id % 16 = 9 THEN 'twin'
                 ELSE 'square' END AS shape FROM fp),
fp_part AS (
  SELECT * FROM (VALUES
    ('square', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE),
    ('corner', 0, 0, 1, 0.5), ('corner', 0, 0.5, 0.5, 1),
    ('courtyard', 0, 0, 1, 0.25), ('courtyard', 0, 0.75, 1, 1), ('courtyard', 0, 0.25, 0.25, 0.75),
    ('courtyard', 0.75, 0.25, 1, 0.75),
    ('twin', 0, 0, 0.375, 1), ('twin', 0.625, 0, 1, 1)) AS v(shape, px0, py0, px1, py1)),
fp_box AS (
  SELECT id, custkey, bf_source, x0 + side * px0 AS bx0, y0 + side * py0 AS by0, x0 + side * px1 AS bx1,
         y0 + side * py1 AS by1
  FROM fp_shape JOIN fp_part USING (shape)),
fp_all AS (
  SELECT id, custkey, bf_source, x0 AS minx, y0 AS miny, x0 + side AS maxx, y0 + side AS maxy,
         CASE shape WHEN 'square' THEN 1.0 WHEN 'twin' THEN 0.75 ELSE 0.75 END::DOUBLE * side * side AS area_deg2,
         CASE shape WHEN 'square' THEN 5 WHEN 'corner' THEN 7 ELSE 10 END::BIGINT AS n_points, shape
  FROM fp_shape),
area_key AS (
  SELECT s_suppkey AS key, s_name, n_name, 'aoi_' || lpad(s_suppkey::VARCHAR, 9, '0') AS slug,
         s_suppkey // 50 AS town, s_suppkey % 50 AS seat,
         CASE s_suppkey % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'corner' WHEN 2 THEN 'holed' ELSE 'parts' END AS shape
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
area AS (
  SELECT *,
    CASE WHEN seat = 0 THEN (-45.4::DOUBLE + (town % 400) * 0.25::DOUBLE) - 0.00013::DOUBLE
         ELSE (-45.4::DOUBLE + (town % 400) * 0.25::DOUBLE) + (seat % 10) * 0.019::DOUBLE + 0.00013::DOUBLE
              - CASE WHEN key % 25 = 24 THEN 124.6::DOUBLE ELSE 0 END END AS x0,
    CASE WHEN seat = 0 THEN (-21.95::DOUBLE + (town // 400 % 300) * 0.2::DOUBLE) - 0.00017::DOUBLE
         ELSE (-21.95::DOUBLE + (town // 400 % 300) * 0.2::DOUBLE) + (seat // 10) * 0.027::DOUBLE
              + 0.00017::DOUBLE END AS y0,
    CASE WHEN seat = 0 THEN 0.2003::DOUBLE ELSE 0.011::DOUBLE + (key % 7) * 0.004::DOUBLE END AS w,
    CASE WHEN seat = 0 THEN 0.1503::DOUBLE ELSE 0.009::DOUBLE + (key % 5) * 0.005::DOUBLE END AS h
  FROM area_key),
aoi AS (
  SELECT slug, key, shape, s_name, n_name, w, h, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy,
         (y0 + (y0 + h)) / 2 AS lat,
         {M2} * cos(radians((y0 + (y0 + h)) / 2)) AS factor,
         abs(((y0 + h) - y0) * 111::DOUBLE
             * (((x0 + w) - x0) * 111::DOUBLE * cos(radians((y0 + (y0 + h)) / 2)))) AS bbox_km2,
         s_name || CASE WHEN key % 5 <> 4 THEN '/' || n_name ELSE '' END AS display_name,
         CASE WHEN key % 3 <> 0 THEN w * h * 12321::DOUBLE END AS stated_km2
  FROM area),
aoi_part AS (
  SELECT * FROM (VALUES
    ('box', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE),
    ('corner', 0, 0, 1, 0.5), ('corner', 0, 0.5, 0.5, 1),
    ('holed', 0, 0, 1, 0.25), ('holed', 0, 0.75, 1, 1), ('holed', 0, 0.25, 0.25, 0.75),
    ('holed', 0.75, 0.25, 1, 0.75),
    ('parts', 0, 0, 0.375, 1), ('parts', 0.625, 0, 1, 1)) AS v(shape, px0, py0, px1, py1)),
aoi_box AS (
  SELECT slug, a.minx + w * px0 AS ax0, a.miny + h * py0 AS ay0, a.minx + w * px1 AS ax1, a.miny + h * py1 AS ay1
  FROM aoi a JOIN aoi_part USING (shape)),
pair AS (
  SELECT id, slug, bf_source,
         sum((least(bx1, ax1) - greatest(bx0, ax0)) * (least(by1, ay1) - greatest(by0, ay0))) AS area_deg2,
         min(greatest(bx0, ax0)) AS minx, min(greatest(by0, ay0)) AS miny,
         max(least(bx1, ax1)) AS maxx, max(least(by1, ay1)) AS maxy
  FROM fp_box JOIN aoi_box ON bx0 <= ax1 AND bx1 >= ax0 AND by0 <= ay1 AND by1 >= ay0
  GROUP BY id, slug, bf_source),
clip AS (SELECT p.id, p.slug, p.bf_source, p.area_deg2, a.factor, p.area_deg2 * a.factor AS m2, a.shape
         FROM pair p JOIN aoi a USING (slug)),
country AS (
  SELECT c_custkey AS custkey, CASE r_name WHEN 'AFRICA' THEN 'LSO' WHEN 'AMERICA' THEN 'BRA' WHEN 'ASIA' THEN 'IND'
         WHEN 'EUROPE' THEN 'PRT' WHEN 'MIDDLE EAST' THEN 'EGY' END AS country_iso
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

SUMMARY = """
summary AS (
  SELECT slug AS aoi, bf_source, count(*) AS n, sum(area_deg2) * max(factor) AS area_m2,
         sum(area_deg2) * max(factor) / count(*) AS mean_m2
  FROM clip GROUP BY slug, bf_source)
"""

WIDE = """
wide0 AS (
  SELECT aoi.slug AS aoi, count(clip.slug) AS total,
         count(*) FILTER (bf_source = 'google') AS n_google, count(*) FILTER (bf_source = 'microsoft') AS n_microsoft,
         coalesce(sum(area_deg2) FILTER (bf_source = 'google') * max(aoi.factor), 0) AS area_m2_google,
         coalesce(sum(area_deg2) FILTER (bf_source = 'microsoft') * max(aoi.factor), 0) AS area_m2_microsoft
  FROM aoi LEFT JOIN clip ON clip.slug = aoi.slug GROUP BY aoi.slug),
wide AS (
  SELECT w.*, CASE WHEN n_google > 0 THEN area_m2_google / n_google ELSE 0 END AS mean_m2_google,
         CASE WHEN n_microsoft > 0 THEN area_m2_microsoft / n_microsoft ELSE 0 END AS mean_m2_microsoft,
         a.bbox_km2, coalesce(a.stated_km2, a.bbox_km2) AS official_km2,
         total / a.bbox_km2 AS density_bbox, total / coalesce(a.stated_km2, a.bbox_km2) AS density_official
  FROM wide0 w JOIN aoi a ON a.slug = w.aoi)
"""

BUCKETS = """
cell AS (SELECT s.bf_source, b.bucket
         FROM (VALUES ('google'), ('microsoft')) s(bf_source),
              (VALUES ('<50'), ('50-100'), ('100-200'), ('200-500'), ('>=500')) b(bucket)),
classed AS (
  SELECT slug, bf_source, CASE WHEN m2 < 50 THEN '<50' WHEN m2 < 100 THEN '50-100' WHEN m2 < 200 THEN '100-200'
         WHEN m2 < 500 THEN '200-500' ELSE '>=500' END AS bucket, count(*) AS n FROM clip GROUP BY ALL)
"""

# the lattice of the edge-contact query: every coordinate is a multiple of 1/512
LATTICE = """
lot AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 / 256::DOUBLE ELSE 1 / 512::DOUBLE END AS size,
         -180::DOUBLE + ((o_orderkey // 7500) % 1440) * 0.25::DOUBLE + (o_orderkey % 7500 % 64) / 256::DOUBLE AS bx0,
         -90::DOUBLE + ((o_orderkey // 7500 // 1440) % 360) * 0.5::DOUBLE
           + (o_orderkey % 7500 // 64) / 256::DOUBLE AS by0
  FROM orders),
site AS (
  SELECT s_suppkey::VARCHAR AS slug,
         -180::DOUBLE + ((s_suppkey // 50) % 1440) * 0.25::DOUBLE + (s_suppkey % 50 % 10) * 0.0234375::DOUBLE AS ax0,
         -90::DOUBLE + ((s_suppkey // 50 // 1440) % 360) * 0.5::DOUBLE + (s_suppkey % 50 // 10) * 0.09375::DOUBLE AS ay0
  FROM supplier),
site_part AS (
  SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 0.03125::DOUBLE, 0.015625::DOUBLE), (0, 0.046875, 0.03125, 0.0625),
    (0, 0.015625, 0.0078125, 0.046875), (0.0234375, 0.015625, 0.03125, 0.046875)) AS v(px0, py0, px1, py1)),
site_box AS (
  SELECT slug, ax0 + px0 AS ax0, ay0 + py0 AS ay0, ax0 + px1 AS ax1, ay0 + py1 AS ay1 FROM site, site_part)
"""


# blocks as disjoint boxes
BLOCKS = """
block AS (
  SELECT c_custkey AS id, (-45.4::DOUBLE + ((c_custkey // 750) % 400) * 0.25::DOUBLE) + (c_custkey % 750 % 25) * 0.007::DOUBLE AS x0,
         (-21.95::DOUBLE + ((c_custkey // 750 // 400) % 300) * 0.2::DOUBLE) + (c_custkey % 750 // 25) * 0.004::DOUBLE AS y0,
         0.013::DOUBLE + (c_custkey % 9) * 0.011::DOUBLE AS side FROM customer),
block_box AS (
  SELECT id, x0 + side * px0 AS bx0, y0 + side * py0 AS by0, x0 + side * px1 AS bx1, y0 + side * py1 AS by1
  FROM block JOIN fp_part ON shape = CASE WHEN id % 4 = 1 THEN 'courtyard' ELSE 'square' END)
"""


def _world(select: str, *more: str) -> str:
    return f"WITH {','.join((WORLD, *more))} {select}"


def _rounded(columns: str, digits: int) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))


ORACLES: dict[str, str] = {
    "read_country_count": _world("""
        SELECT bf_source, count(*) AS n FROM fp_all JOIN country USING (custkey) WHERE country_iso = 'BRA'
        GROUP BY bf_source"""),
    "single_vs_merged": _world("""
        SELECT ['LSO', 'BRA', 'IND', 'PRT', 'EGY', 'DZA', 'ARG', 'JPN', 'FRA', 'SAU', 'KEN', 'CAN', 'IDN', 'DEU', 'IRN', 'MOZ', 'PER',
                'VNM', 'ROU', 'JOR', 'NGA', 'USA', 'CHN', 'GBR', 'IRQ'][c_nationkey + 1] AS country_iso,
               count(*) AS n_merged, count(*) FILTER (bf_source = 'google') AS n_single,
               count(*) FILTER (bf_source <> 'google') AS added
        FROM fp_all JOIN customer ON c_custkey = custkey GROUP BY c_nationkey"""),
    "only_in_merged": _world("SELECT id, bf_source FROM fp_all WHERE bf_source = 'microsoft' OR id % 5 = 0"),
    "analyze_files": _world(f"""
        SELECT slug AS aoi, bf_source, count(*) AS n, round(sum(area_deg2) * max(factor), 2) AS area_m2,
               round(sum(area_deg2) * max(factor) / count(*), 2) AS mean_m2
        FROM clip JOIN fp USING (id, bf_source) JOIN country USING (custkey) WHERE country_iso = 'BRA'
        GROUP BY slug, bf_source"""),
    "read_materialised": _world(f"SELECT aoi, bf_source, n, {_rounded('area_m2, mean_m2', 2)} FROM summary", SUMMARY),
    "list_aois": _world("""
        SELECT slug, s_name AS nome, (3100000 + key)::VARCHAR AS code FROM aoi WHERE key % 20 NOT IN (7, 14)"""),
    "get_aoi": _world(f"SELECT slug, display_name, {_rounded('minx, miny, maxx, maxy', 6)} FROM aoi WHERE key = 1"),
    "aoi_violations": _world("""
        SELECT slug, CASE key % 20
            WHEN 7 THEN 'not a FeatureCollection; not exactly one feature; not Polygon or MultiPolygon'
            WHEN 8 THEN 'not a FeatureCollection' WHEN 9 THEN 'not exactly one feature'
            WHEN 10 THEN 'not Polygon or MultiPolygon' WHEN 11 THEN 'no coordinates'
            WHEN 12 THEN 'longitude outside [-180, 180]' WHEN 13 THEN 'latitude outside [-90, 90]'
            WHEN 14 THEN 'not exactly one feature; not Polygon or MultiPolygon' ELSE '' END AS violations FROM aoi"""),
    "aoi_bounds": _world(f"""
        SELECT slug, {_rounded('minx, miny, maxx, maxy, bbox_km2', 6)}, round(lat, 6) AS lat_mean FROM aoi"""),
    "aoi_display": _world("""
        SELECT slug, display_name, round(coalesce(stated_km2, bbox_km2), 6) AS official_km2,
               (key * 7 + 100)::BIGINT AS population FROM aoi"""),
    "ring_checks": _world("""
        SELECT slug, (CASE WHEN shape IN ('holed', 'parts') THEN 2 ELSE 1 END)::BIGINT AS n_rings, true AS closed,
               true AS four_points, minx >= -74 AND maxx <= -34 AND miny >= -34 AND maxy <= 5 AS in_country FROM aoi"""),
    "aoi_enriched": _world("""
        SELECT slug, CASE WHEN key % 3 = 0 THEN slug ELSE s_name END AS nome,
               CASE WHEN key % 3 = 1 THEN '9999999' ELSE (3100000 + key)::VARCHAR END AS code,
               'official boundaries' AS origin, (CASE WHEN shape = 'parts' THEN 2 ELSE 1 END)::BIGINT AS n_parts
        FROM aoi"""),
    "filter_source": _world("SELECT id, bf_source FROM fp_all WHERE bf_source = 'microsoft'"),
    "filter_min_area": _world(f"SELECT id FROM fp_all WHERE area_deg2 * {FACTOR_2188} >= 200"),
    "filter_min_area_equatorial": _world(f"SELECT id FROM fp_all WHERE area_deg2 * {M2} >= 200"),
    "footprint_area_m2": _world(f"""
        SELECT id, round(area_deg2 * {FACTOR_2188}, 2) AS area_m2,
               round(area_deg2 * {FACTOR_2188}, 2) / 10000 AS area_ha FROM fp_all"""),
    "bbox_centre": _world("""
        SELECT id, round((minx + maxx) / 2, 6) AS centre_lon, round((miny + maxy) / 2, 6) AS centre_lat FROM fp_all"""),
    "simplify_vertices": _world("""
        SELECT id, CASE shape WHEN 'square' THEN 9 WHEN 'corner' THEN 13 ELSE 18 END::BIGINT AS n_before,
               n_points AS n_after FROM fp_all"""),
    "simplify_slanted": _world("""
        SELECT id, CASE shape WHEN 'square' THEN 9 WHEN 'corner' THEN 13 ELSE 18 END::BIGINT AS n_before,
               CASE WHEN id % 2 = 0 THEN n_points ELSE CASE shape WHEN 'square' THEN 9 WHEN 'corner' THEN 13 ELSE 18 END END::BIGINT AS n_after
        FROM fp_all"""),
    "spatial_join_pairs": _world("SELECT id, slug FROM pair"),
    "spatial_join_touch": f"""WITH {LATTICE}
        SELECT id, slug, sum(greatest(0, least(bx0 + size, ax1) - greatest(bx0, ax0))
                             * greatest(0, least(by0 + size, ay1) - greatest(by0, ay0))) = 0 AS touch_only
        FROM lot JOIN site_box ON bx0 <= ax1 AND bx0 + size >= ax0 AND by0 <= ay1 AND by0 + size >= ay0
        GROUP BY id, slug""",
    "spatial_join_shuffled": _world("""
        SELECT slug, count(*) AS n, sum(id)::BIGINT AS id_sum FROM pair GROUP BY slug"""),
    "spatial_join_large": _world(f"""
        SELECT id, slug, round(sum((least(bx1, ax1) - greatest(bx0, ax0)) * (least(by1, ay1) - greatest(by0, ay0))) * {M2}, 2) AS area_m2
        FROM block_box JOIN aoi_box ON bx0 <= ax1 AND bx1 >= ax0 AND by0 <= ay1 AND by1 >= ay0 GROUP BY id, slug""", BLOCKS),
    "shape_pairs": _world(f"""
        SELECT b.id AS block, f.id, round(sum(greatest(0, least(b.bx1, f.bx1) - greatest(b.bx0, f.bx0))
                                              * greatest(0, least(b.by1, f.by1) - greatest(b.by0, f.by0))) * {M2}, 3) AS shared_m2
        FROM block_box b JOIN fp_box f ON b.bx0 <= f.bx1 AND b.bx1 >= f.bx0 AND b.by0 <= f.by1 AND b.by1 >= f.by0
        GROUP BY b.id, f.id""", BLOCKS),
    "only_in_merged_by_shape": _world("""
        SELECT f.id, f.bf_source FROM fp_all f LEFT JOIN (
            SELECT a.id, b.id AS other, sum(greatest(0, least(a.bx1, b.bx1 + 0.00001) - greatest(a.bx0, b.bx0 + 0.00001))
                                            * greatest(0, least(a.by1, b.by1) - greatest(a.by0, b.by0))) AS shared
            FROM fp_box a JOIN fp_box b ON a.bx0 <= b.bx1 + 0.00001 AND a.bx1 >= b.bx0 + 0.00001 AND a.by0 <= b.by1 AND a.by1 >= b.by0
            WHERE b.bf_source = 'google' AND b.id % 5 <> 0 GROUP BY a.id, b.id) p ON p.id = f.id
        GROUP BY f.id, f.bf_source, f.area_deg2 HAVING coalesce(max(shared), 0) <= f.area_deg2 * 0.5"""),
    "bbox_candidates": _world("""
        SELECT count(*) AS n FROM fp_all f WHERE EXISTS (
            SELECT 1 FROM aoi a WHERE f.maxx >= a.minx AND f.minx <= a.maxx AND f.maxy >= a.miny AND f.miny <= a.maxy)"""),
    "clip_area": _world("SELECT id, slug, round(m2, 2) AS area_m2 FROM clip"),
    "clip_by_shape": _world(f"""
        SELECT shape, count(*) AS n, round(sum(area_deg2) * {M2}, 2) AS area_m2 FROM clip GROUP BY shape"""),
    "clip_geometry": _world(f"""
        SELECT id, slug, round(p.area_deg2 * factor, 2) AS area_m2,
               round(p.minx, 6) AS minx, round(p.miny, 6) AS miny, round(p.maxx, 6) AS maxx, round(p.maxy, 6) AS maxy
        FROM pair p JOIN aoi a USING (slug)"""),
    "count_total": _world("SELECT count(*) AS n FROM clip"),
    "count_by_source": _world("SELECT bf_source, count(*) AS n FROM clip GROUP BY bf_source"),
    "area_by_source": _world(f"""
        SELECT bf_source, round(sum(area_deg2) * {FACTOR_2188}, 2) AS area_m2 FROM clip GROUP BY bf_source"""),
    "mean_area_by_source": _world(f"""
        SELECT bf_source, count(*) AS n, round(sum(area_deg2) * {FACTOR_2188}, 2) AS area_m2,
               round(sum(area_deg2) * {FACTOR_2188} / count(*), 2) AS mean_m2 FROM clip GROUP BY bf_source"""),
    "distinct_sources": _world("SELECT DISTINCT bf_source FROM clip"),
    "aoi_summary": _world(f"SELECT aoi, bf_source, n, {_rounded('area_m2, mean_m2', 2)} FROM summary", SUMMARY),
    "aoi_summary_maps": _world("""
        SELECT slug AS aoi, display_name, coalesce(sum(n), 0)::BIGINT AS total,
               coalesce(max(n) FILTER (bf_source = 'google'), 0)::BIGINT AS n_google,
               round(max(area_m2) FILTER (bf_source = 'microsoft'), 2) AS area_microsoft,
               round(max(mean_m2) FILTER (bf_source = 'google'), 2) AS mean_google
        FROM aoi LEFT JOIN summary ON aoi.slug = summary.aoi GROUP BY slug, display_name""", SUMMARY),
    "compare_aois": _world(f"""
        SELECT aoi, total, n_google, n_microsoft, {_rounded('''area_m2_google, area_m2_microsoft, mean_m2_google,
            mean_m2_microsoft, bbox_km2, density_bbox''', 3)} FROM wide""", WIDE),
    "density_official": _world(f"SELECT aoi, {_rounded('official_km2, density_official', 3)} FROM wide", WIDE),
    "share_by_source": _world("""
        SELECT aoi, bf_source, n, round(100::DOUBLE * n / sum(n) OVER (PARTITION BY aoi), 6) AS pct
        FROM summary""", SUMMARY),
    "area_histogram": _world("""
        SELECT a.slug AS aoi, c.bf_source, c.bucket, coalesce(n, 0)::BIGINT AS n
        FROM aoi a CROSS JOIN cell c LEFT JOIN classed k
          ON k.slug = a.slug AND k.bf_source = c.bf_source AND k.bucket = c.bucket""", BUCKETS),
    "comparison_table": _world(f"""
        SELECT aoi, total, n_google, n_microsoft, {_rounded('official_km2, density_bbox, density_official', 3)}
        FROM wide""", WIDE),
    "built_area_gap": _world("""
        SELECT aoi, round(area_m2_google + area_m2_microsoft, 2) AS built_m2,
               round(abs(mean_m2_google - mean_m2_microsoft), 2) AS gap_m2,
               mean_m2_google > mean_m2_microsoft AS google_larger FROM wide""", WIDE),
    "coverage_class": _world("""
        SELECT aoi, coalesce(round(100::DOUBLE * n_google / nullif(total, 0), 6), 0) AS google_pct,
               CASE WHEN 100::DOUBLE * n_google / nullif(total, 0) >= 90 THEN 'google dominates'
                    WHEN 100::DOUBLE * n_google / nullif(total, 0) >= 70 THEN 'significant microsoft'
                    ELSE 'prominent microsoft' END AS coverage FROM wide""", WIDE),
    "aoi_ratio": _world("""
        SELECT a.slug AS aoi_a, b.slug AS aoi_b, round(x.total / nullif(y.total, 0), 4) AS n_ratio,
               round((x.area_m2_google + x.area_m2_microsoft) / nullif(y.area_m2_google + y.area_m2_microsoft, 0), 4)
                 AS built_ratio,
               round(x.official_km2 / y.official_km2, 4) AS km2_ratio,
               round(x.density_official / nullif(y.density_official, 0), 4) AS density_ratio
        FROM aoi a JOIN aoi b ON b.key = a.key + 1 JOIN wide x ON x.aoi = a.slug JOIN wide y ON y.aoi = b.slug""",
                        WIDE),
    "layers": _world("""
        SELECT slug AS aoi, bf_source, count(*) AS n, round(sum(round(m2, 2)), 2) AS area_m2,
               round(sum(area_deg2 * 1e9), 2) AS simplified_area
        FROM clip WHERE m2 >= 100 GROUP BY slug, bf_source"""),
    "write_layers": _world("""
        SELECT a.slug AS aoi, s.bf_source, count(DISTINCT c.id) AS n, coalesce(round(sum(round(m2, 2)), 2), 0.0) AS area_m2,
               greatest(1, ceil(count(c.id) / 500))::BIGINT AS n_files
        FROM aoi a CROSS JOIN (VALUES ('google'), ('microsoft')) s(bf_source)
        LEFT JOIN clip c ON c.slug = a.slug AND c.bf_source = s.bf_source AND m2 >= 100 GROUP BY ALL"""),
    "summary_json": _world(f"SELECT aoi, bf_source, n, {_rounded('area_m2, mean_m2', 2)} FROM summary", SUMMARY),
    "write_clip": _world(f"SELECT aoi, bf_source, n, {_rounded('area_m2, mean_m2', 2)} FROM summary", SUMMARY),
    "read_features": _world("""
        SELECT slug, i AS feature_no, CASE WHEN key % 20 = 10 THEN 0
                                          WHEN shape = 'parts' AND key % 20 NOT IN (11, 12, 13) THEN 2 ELSE 1 END::BIGINT AS n_parts,
               s_name AS nome
        FROM aoi, LATERAL (SELECT unnest(range(0, CASE key % 20 WHEN 9 THEN 2 WHEN 14 THEN 0 WHEN 7 THEN 0 ELSE 1 END)) AS i)"""),
    "geojson_roundtrip": _world(f"""
        SELECT id, bf_source, 2::BIGINT AS n_properties, round(area_deg2 * {FACTOR_2188}, 2) AS area_m2 FROM fp_all"""),
    "geoparquet_roundtrip": _world(f"""
        SELECT id, bf_source, round(area_deg2 * {FACTOR_2188}, 2) AS area_m2, round(minx, 6) AS minx, round(maxy, 6) AS maxy
        FROM fp_all"""),
    "geoparquet_index": _world("""
        SELECT CASE bf_source WHEN 'google' THEN 'EPSG:4326' ELSE 'OGC:CRS84' END AS crs, '1.1.0' AS version, 'geometry' AS primary_column,
               'WKB' AS encoding, count(*) AS n_rows, round(min(minx), 6) AS minx, round(min(miny), 6) AS miny, round(max(maxx), 6) AS maxx,
               round(max(maxy), 6) AS maxy FROM fp_all GROUP BY bf_source"""),
    "geoparquet_clip": _world(f"""
        SELECT aoi, s.bf_source, n, {_rounded('area_m2, mean_m2', 2)}, 'EPSG:4326, OGC:CRS84' AS labels
        FROM summary s JOIN area_key k ON k.slug = s.aoi WHERE town % 5 = 0""", SUMMARY),
    "file_pruning": _world("""
        SELECT count(*) AS n_candidates, count(*) AS n_all, true AS pruned FROM fp_all f WHERE EXISTS (
            SELECT 1 FROM aoi a WHERE a.key < 50 AND a.minx > -100 AND f.maxx >= a.minx AND f.minx <= a.maxx AND f.maxy >= a.miny AND f.miny <= a.maxy)"""),
    "sorted_geometries": _world("""
        SELECT CASE WHEN id % 11 = 0 THEN 'truncated WKB geometry' WHEN id % 13 = 0 THEN 'ring is not closed'
                    WHEN id % 17 = 0 THEN 'ring has fewer than four points' ELSE 'none' END AS problem, count(*) AS n, sum(id)::BIGINT AS id_sum
        FROM fp_all GROUP BY 1"""),
    "typed_properties": _world("""
        SELECT slug, k AS key, CASE k WHEN 'checked' THEN 'boolean' WHEN 'none' THEN 'void' WHEN 'populacao_2022' THEN 'bigint'
                                      WHEN 'ratio' THEN 'double' WHEN 'area_km2_oficial' THEN 'double' ELSE 'string' END AS kind, v AS value
        FROM (SELECT slug, unnest(['checked', 'none', 'ratio', 'tags', 'nome', 'uf', 'ibge_code', 'area_km2_oficial', 'tipologia', 'populacao_2022']) AS k,
                     unnest([(key % 2 = 0)::VARCHAR, NULL, (key / 4)::DOUBLE::VARCHAR, '[1,' || key || ']', s_name,
                             CASE WHEN key % 5 <> 4 THEN n_name END, (3100000 + key)::VARCHAR, stated_km2::VARCHAR, shape, (key * 7 + 100)::VARCHAR]) AS v FROM aoi)
        WHERE v IS NOT NULL OR k = 'none'"""),
    "payload_typed": _world(f"""
        SELECT slug AS aoi, total, s_name AS nome, (key * 7 + 100)::BIGINT AS population, round(stated_km2, 4) AS stated_km2,
               round(coalesce(stated_km2, a.bbox_km2), 4) AS official_km2 FROM aoi a JOIN wide w ON w.aoi = a.slug""", WIDE),
    "wkb_decode": _world("""
        SELECT id, CASE shape WHEN 'square' THEN 93 WHEN 'corner' THEN 125 WHEN 'courtyard' THEN 177
                   ELSE 195 END::BIGINT AS n_bytes,
               CASE shape WHEN 'twin' THEN 2 ELSE 1 END::BIGINT AS n_parts,
               CASE WHEN shape IN ('twin', 'courtyard') THEN 2 ELSE 1 END::BIGINT AS n_rings, n_points
        FROM fp_all"""),
    "dashboard_payload": _world("""
        SELECT a.slug AS aoi, a.display_name, coalesce(w.total, 0)::BIGINT AS total, round(a.miny, 4) AS south,
               round(a.maxx, 4) AS east,
               'data/aoi=' || a.slug || '/bf_source=google/part=' || greatest(0, ceil(coalesce(f.n, 0) / 50)::BIGINT - 1) AS google_file,
               coalesce(w.n_microsoft, 0)::BIGINT AS n_microsoft,
               coalesce(k.n, 0)::BIGINT AS big_google,
               round(coalesce(a.stated_km2, a.bbox_km2), 4) AS official_km2
        FROM aoi a LEFT JOIN wide w ON w.aoi = a.slug
        LEFT JOIN classed k ON k.slug = a.slug AND k.bf_source = 'google' AND k.bucket = '>=500'
        LEFT JOIN (SELECT slug, count(*) AS n FROM clip WHERE bf_source = 'google' AND m2 >= 100 GROUP BY slug) f
          ON f.slug = a.slug""", WIDE, BUCKETS),
    "table_stats": _world("""
        SELECT 'footprints_' || lower(country_iso) AS table_name, count(*) AS n_rows, true AS prunable
        FROM fp_all JOIN country USING (custkey) GROUP BY country_iso
        UNION ALL SELECT 'aoi_all', count(*), false FROM aoi
        UNION ALL SELECT 'recorte_all', count(*), false FROM clip"""),
    "prune_dry_run": _world("""
        SELECT 'footprints_' || lower(country_iso) AS table_name, count(*) AS n_rows
        FROM fp_all JOIN country USING (custkey) GROUP BY country_iso"""),
    "prune_confirmed": _world("""
        SELECT 'aoi_all' AS table_name, count(*) AS n_rows FROM aoi
        UNION ALL SELECT 'recorte_all', count(*) FROM clip"""),
    "compact_counts": _world("SELECT bf_source, count(*) AS n FROM clip GROUP BY bf_source"),
    "describe_table": _world("""
        SELECT v.column_name, v.column_type, n AS n_values
        FROM (SELECT count(*) AS n FROM fp_all JOIN country USING (custkey) WHERE country_iso = 'BRA'),
             (VALUES ('id', 'bigint'), ('bf_source', 'string'), ('country_iso', 'string')) v(column_name, column_type)
        """),
}
