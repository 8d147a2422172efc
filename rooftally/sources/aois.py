"""Areas of interest: GeoJSON documents to rows, their rules, and their editorial metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rooftally.functions import geometry as G
from rooftally.functions import measures as M
from rooftally.functions.plan import compute_once

# Coordinates stay raw JSON text until the geometry type tells how deep they are nested.
_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
DOCUMENT = f"struct<type:string,name:string,features:array<{_FEATURE}>>"
_POLYGON = "array<array<array<double>>>"

# The two municipalities shipped as defaults, by file stem.
DEFAULT_METADATA = {
    "cambuquira_mg": {"nome": "Cambuquira", "uf": "MG", "ibge_code": "3110707", "area_km2_oficial": "246.38",
                      "tipologia": "municipio_rural_pequeno", "populacao_2022": "12609"},
    "uberlandia_mg": {"nome": "Uberlandia", "uf": "MG", "ibge_code": "3170206", "area_km2_oficial": "4115.206",
                      "tipologia": "cidade_media_urbana_consolidada", "populacao_2022": "713224"},
}
NAMES_IN_ERROR = 20  # of existing areas
VIOLATIONS = ("not a FeatureCollection", "not exactly one feature", "not Polygon or MultiPolygon",
              "no coordinates", "longitude outside [-180, 180]", "latitude outside [-90, 90]")


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Raw documents as (slug, document).

    A folder of ``<slug>.geojson`` files, or text files with one document per line whose slug is the
    document's ``name``. A missing folder gives no rows.
    """
    try:
        if one_per_line:
            lines = spark.read.text(path).withColumnRenamed("value", "document")
            return lines.select(F.get_json_object("document", "$.name").alias("slug"), "document")
        files = spark.read.option("pathGlobFilter", "*.geojson").text(path, wholetext=True)
        stem = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.geojson$", 1)
        return files.select(stem.alias("slug"), F.col("value").alias("document"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "slug string, document string")


def _parsed() -> Column:
    return F.from_json("document", DOCUMENT, {"mode": "PERMISSIVE"})


def _multipolygon(kind: Column, coordinates: Column) -> Column:
    return (F.when(kind == "Polygon", F.array(F.from_json(coordinates, _POLYGON)))
            .when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{_POLYGON}>")))


def _opened(documents: DataFrame) -> DataFrame:
    """Documents with their type, feature count and the parts of their first feature, parsed once."""
    def fields(doc):
        first = F.get(doc.features, F.lit(0))
        return F.struct(doc.type.alias("_type"), F.size(doc.features).alias("_n"),
                        first["properties"].alias("properties"), first["geometry"]["type"].alias("_kind"),
                        first["geometry"]["coordinates"].alias("_coordinates"))

    return documents.select("slug", "document", F.inline(F.transform(F.array(_parsed()), fields)))


def list_aois(documents: DataFrame) -> DataFrame:
    """Every readable document with its first feature's properties, by slug.

    Text that is not JSON, and an empty feature list, are left out; a missing feature list is kept with no
    properties.
    """
    opened = compute_once(_opened(documents), _json=F.try_parse_json("document").isNotNull())
    no_properties = F.create_map().cast("map<string,string>")
    return (opened.where(F.col("_json") & (F.col("_n").isNull() | (F.col("_n") != 0)))
            .select("slug", F.coalesce("properties", no_properties).alias("properties"))
            .orderBy("slug"))


def check_aois(documents: DataFrame) -> DataFrame:
    """All documents with geometry, bounds and the list of broken rules, in one pass."""
    shaped = compute_once(_opened(documents).drop("document"), mp=_multipolygon(F.col("_kind"), F.col("_coordinates")))
    listed = compute_once(shaped, _x=F.expr(f"transform({G.points('mp')}, p -> p[0])"),
                          _y=F.expr(f"transform({G.points('mp')}, p -> p[1])"))
    located = compute_once(listed, minx=F.array_min("_x"), miny=F.array_min("_y"),
                           maxx=F.array_max("_x"), maxy=F.array_max("_y"))
    polygonal = F.coalesce(F.col("_kind").isin("Polygon", "MultiPolygon"), F.lit(False))
    rules = (
        ~F.col("_type").eqNullSafe("FeatureCollection"),
        F.coalesce(F.col("_n"), F.lit(0)) != 1,
        ~polygonal,
        polygonal & F.col("minx").isNull(),
        (F.col("minx") < -180) | (F.col("maxx") > 180),
        (F.col("miny") < -90) | (F.col("maxy") > 90),
    )
    broken = F.array_compact(F.array(*[F.when(rule, text) for rule, text in zip(rules, VIOLATIONS)]))
    return (compute_once(located, violations=broken)
            .select("slug", "mp", "minx", "miny", "maxx", "maxy", "properties", "violations"))


def read_aois(documents: DataFrame) -> DataFrame:
    """The valid areas, one row each: slug, geometry, bounds, properties, display name."""
    properties = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    return (check_aois(documents).where(F.size("violations") == 0)
            .withColumn("properties", properties)
            .select("slug", M.display_name(F.col("properties"), F.col("slug")).alias("display_name"), "mp",
                    "minx", "miny", "maxx", "maxy", "properties"))


def read_features(documents: DataFrame) -> DataFrame:
    """Every feature of every document, without the one-feature rule: slug, feature number, geometry, properties."""
    shape = F.col("_f")["geometry"]
    return (documents.select("slug", F.posexplode(_parsed()["features"]).alias("feature_no", "_f"))
            .select("slug", "feature_no", _multipolygon(shape["type"], shape["coordinates"]).alias("mp"),
                    F.col("_f")["properties"].alias("properties")))


def clean_properties(json: str = "_json") -> Column:
    """Properties from a column of JSON text as a map of VARIANT values that any reader of JSON can take.

    Whole numbers, texts, booleans and nulls stay as they are, other numbers become doubles, and lists and objects their JSON text. NULL and text
    that is no object give an empty map.
    """
    kind = "upper(schema_of_variant(v))"
    value = f"""CASE WHEN {kind} LIKE 'DECIMAL%' OR {kind} IN ('FLOAT', 'DOUBLE') THEN cast(cast(v AS double) AS variant)
        WHEN {kind} LIKE 'ARRAY%' OR {kind} LIKE 'OBJECT%' THEN cast(to_json(v) AS variant) ELSE v END"""
    return F.expr(f"""coalesce(transform_values(try_variant_get(try_parse_json({json}), '$', 'map<string, variant>'), (k, v) -> {value}),
        cast(map() AS map<string, variant>))""")


def typed_properties(documents: DataFrame) -> DataFrame:
    """(slug, properties) of each document's first feature, with values that keep their type: see ``clean_properties``."""
    return documents.select("slug", F.get_json_object("document", "$.features[0].properties").alias("_json")).select(
        "slug", clean_properties().alias("properties"))


def get_aoi(documents: DataFrame, slug: str) -> DataFrame:
    """One valid area; an unknown slug or a broken rule is an error."""
    found = check_aois(documents.where(F.col("slug") == slug)).select("violations").take(1)
    if not found:
        known = [r.slug for r in list_aois(documents).select("slug").take(NAMES_IN_ERROR)]
        raise LookupError(f"area {slug!r} not found; there are, among others, {', '.join(known) or 'none'}")
    if found[0].violations:
        raise ValueError(f"area {slug!r} is not valid: {'; '.join(found[0].violations)}")
    return read_aois(documents.where(F.col("slug") == slug))


def ring_checks(aois: DataFrame, country_box: tuple[float, float, float, float]) -> DataFrame:
    """Per area: are all rings closed, have four points, and lie inside the country's box?"""
    minx, miny, maxx, maxy = country_box
    rings = F.flatten("mp")
    return aois.select(
        "slug",
        F.size(rings).cast("bigint").alias("n_rings"),
        F.forall(rings, lambda r: F.get(r, F.lit(0)).eqNullSafe(F.try_element_at(r, F.lit(-1)))).alias("closed"),
        F.forall(rings, lambda r: F.size(r) >= 4).alias("four_points"),
        F.forall(F.expr(G.points("mp")), lambda p: p[0].between(minx, maxx) & p[1].between(miny, maxy))
        .alias("in_country"),
    )


def default_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_METADATA.items()),
                                 T.StructType([T.StructField("slug", T.StringType()),
                                               T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))


def enrich_aois(boundaries: DataFrame, metadata: DataFrame, code: str, source_label: str) -> DataFrame:
    """Attach editorial metadata to boundaries by slug; only absent keys get defaults.

    ``boundaries`` has ``slug``, the seven-digit municipal ``code`` column and the geometry columns;
    ``metadata`` has ``slug`` and a ``metadata`` map. Bad slugs and codes are errors.
    """
    joined = boundaries.join(metadata, "slug", "left")
    own = F.coalesce("metadata", F.map_from_arrays(F.array(F.lit("nome")), F.array("slug")))
    defaults = F.map_from_arrays(F.array(F.lit("ibge_code"), F.lit("fonte_poligono")),
                                 F.array(F.col(code).cast("string"), F.lit(source_label)))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k))
    # the slug is letters and digits with underscores anywhere, but not underscores alone
    slug = (F.when(F.col("slug").rlike(r"^_*[A-Za-z0-9][A-Za-z0-9_]*$"), F.col("slug"))
            .otherwise(F.raise_error(F.concat(F.lit("bad slug: "), "slug"))))
    checked = F.when(F.col(code).cast("string").rlike(r"^[0-9]{7}$"), F.map_concat(own, missing)).otherwise(
        F.raise_error(F.concat(F.lit("bad municipal code for "), "slug")))
    return (joined.withColumn("properties", checked).withColumn("slug", slug)
            .drop("metadata"))
