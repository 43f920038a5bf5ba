"""Layer specs and the one generic instance scan that serves all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import cells, geodesy
from tilewright.functions.predicates import Bound, category_filter, in_bound, model_ok, not_deleted, ring_inside


@dataclass(frozen=True)
class LayerSpec:
    """How one feature table becomes placed instances."""

    table: str
    kind: str
    id_column: str = "id"
    name: str = "id"  # a column, or quoted text
    model: str = "model"  # a column, or "<column>+.glb"
    check_suffix: bool = True
    overlay: tuple[str, ...] = ()  # columns taken from the edit overlay
    from_ring: bool = False  # placed at the centre of the geometry's box
    lift_by_transform: bool = False  # height raised by the third transform value
    stretch_to_height: bool = False  # z scale = height / model height
    turn_half: bool = False  # heading turned by 180 degrees and written as a placement
    keep_without_content: bool = False
    extra: tuple[str, ...] = ()


# The layers, their tables, kinds and column choices.
LAYERS: dict[str, LayerSpec] = {
    s.table: s
    for s in (
        LayerSpec("hdtraffic_qbb", "hdQbb", name="chn_name", extra=("transform", "obj_angle")),
        LayerSpec("hdtraffic_ene_sfz", "hdDevice", name="chn_name", extra=("transform", "obj_angle")),
        LayerSpec("hdtraffic_ene_fwq", "hdDevice", name="chn_name", extra=("transform", "obj_angle")),
        LayerSpec("hdtraffic_ene", "hdDevice", name="chn_name", overlay=("metadata", "service_data"), extra=("transform", "obj_angle")),
        LayerSpec("hdtraffic_sign", "hdSign", overlay=("service_data",),
                  extra=("transform", "obj_angle", "width", "height", "type_code", "road_name", "travel_type", "km_value")),
        LayerSpec("hdpole", "hdPole", id_column="pole_id", overlay=("metadata", "service_data"), extra=("transform", "obj_angle")),
        LayerSpec("hdgantry", "hdGantry", overlay=("metadata", "service_data"), extra=("transform", "obj_angle")),
        LayerSpec("hdtraffic_bridges", "hdBridge", lift_by_transform=True, extra=("transform", "obj_angle", "metadata")),
        LayerSpec("hdroad_side_facility", "hdBuilding", model="id+.glb", check_suffix=False, from_ring=True),
        LayerSpec("hdservice_equ_area", "hdBuilding", model="id+.glb", check_suffix=False, from_ring=True),
        LayerSpec("hdservice_area", "hdBuilding", id_column="fid", name="fid", model="fid+.glb", check_suffix=False,
                  from_ring=True, keep_without_content=True),
        LayerSpec("hd_road_side_billboard", "hdBuilding", model="model_name", extra=("obj_angle",)),
        LayerSpec("hdpole_ld", "hdDevice", name="'lignt'", extra=("transform", "obj_angle")),
        LayerSpec("render_toll_building", "hdBuilding", stretch_to_height=True, extra=("height",)),
        LayerSpec("render_upright_point", "hdBuilding", extra=("transform",)),
        LayerSpec("toll_name", "hdBuilding", model="id+.glb", check_suffix=False, turn_half=True),
        LayerSpec("aa_xxb_model", "hdBuilding", model="model_name", extra=("obj_angle", "transform")),
    )
}

# The uniform instance row: every layer scan returns these columns in this order.
INSTANCE_COLUMNS: dict[str, str] = {
    "table_name": "string", "type": "string", "id": "string", "name": "string", "model": "string",
    "lng": "double", "lat": "double", "alt": "double", "obj_angle": "double", "transform": "array<double>",
    "width": "double", "height": "double", "type_code": "string", "road_name": "string", "travel_type": "string",
    "km_value": "double", "metadata": "string", "service_data": "string", "cell": "bigint",
}


def ring_centre(ring: Column, axis: str) -> Column:
    values = F.transform(ring, lambda p: p[axis])
    return (F.array_min(values) + F.array_max(values)) / 2


def overlay_edits(features: DataFrame, edits: DataFrame, table: str, columns: Iterable[str], id_column: str = "id") -> DataFrame:
    """Left equi-join of the edit rows of one table on text ids."""
    side = edits.where(F.col("feature_table") == table).select(
        F.col("id").cast("string").alias("_key"), *[F.col(c).alias(f"_edit_{c}") for c in columns])
    joined = features.join(side, features[id_column].cast("string") == side["_key"], "left").drop("_key")
    for c in columns:
        joined = joined.withColumn(c, F.col(f"_edit_{c}")).drop(f"_edit_{c}")
    return joined


def scan_layer(
    df: DataFrame, spec: LayerSpec, bound: Bound, level: int = cells.MAX_LEVEL,
    edits: DataFrame | None = None, model_heights: DataFrame | None = None,
) -> DataFrame:
    """All placed instances of a layer inside a bound, each with its cell: one pass for every cell at once.

    A model suffix is required only where the layer asks for it. ``model_heights`` (table_name,
    model, height) gives the extents for layers stretched to their building height.
    """
    if spec.from_ring:
        df = df.withColumns({a: ring_centre(F.col("ring"), k) for a, k in (("lng", "x"), ("lat", "y"), ("alt", "z"))})
    df = df.where(in_bound(F.col("lng"), F.col("lat"), bound))
    base, glued = (spec.model[:-5], True) if spec.model.endswith("+.glb") else (spec.model, False)
    model = F.concat(F.col(base).cast("string"), F.lit(".glb")) if glued else F.col(base)
    if spec.check_suffix:
        df = df.where(model_ok(model))
    if spec.overlay and edits is not None:
        df = overlay_edits(df, edits, spec.table, spec.overlay, spec.id_column)
    values: dict[str, Column] = {c: F.col(c) for c in (*spec.extra, *spec.overlay) if c in df.columns}
    if spec.lift_by_transform:
        df = df.withColumn("alt", F.col("alt") + F.coalesce(F.try_element_at("transform", F.lit(3)), F.lit(0.0)))
    if spec.turn_half:
        one = F.lit(1.0)
        values["obj_angle"] = (F.col("angle") + 180.0) % 360.0
        values["transform"] = geodesy.heading_trs(values["obj_angle"], (one, one, one))
    if spec.stretch_to_height and model_heights is not None:
        dims = model_heights.where(F.col("table_name") == spec.table).select(
            F.col("model").alias("_model"), F.col("height").alias("_tall"))
        df = df.join(dims, model == dims["_model"], "left")
        one = F.lit(1.0)
        values["transform"] = F.when(F.col("_tall").isNotNull(), geodesy.heading_trs(F.lit(0.0), (one, one, F.col("height") / F.col("_tall"))))
    name = F.lit(spec.name.strip("'")) if spec.name.startswith("'") else F.col(spec.name).cast("string")
    values |= {
        "table_name": F.lit(spec.table), "type": F.lit(spec.kind), "id": F.col(spec.id_column).cast("string"), "name": name,
        "model": model, "lng": F.col("lng"), "lat": F.col("lat"), "alt": F.col("alt"),
        "cell": cells.point_code(F.col("lng"), F.col("lat"), level),
    }
    return df.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in INSTANCE_COLUMNS.items()])


def union_layers(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def scan_features(
    df: DataFrame, bound: Bound, ring: str = "ring", category: str | None = None, values: Iterable[str] = (),
    mapping: Mapping[str, str] | None = None, whole: bool = False,
) -> DataFrame:
    """Features with a geometry that meets the bound (or lies wholly inside it) in the wanted categories."""
    from tilewright.functions.predicates import ring_meets_box

    kept = df.where(F.col(ring).isNotNull())
    if category is not None:
        kept = kept.where(category_filter(F.col(category), list(values), mapping))
    west, south, east, north = bound
    if whole:
        return kept.where(ring_inside(F.col(ring), bound))
    return kept.where(ring_meets_box(F.col(ring), F.lit(west), F.lit(south), F.lit(east), F.lit(north)))


def read_table(
    spark: SparkSession, path: str | None = None, jdbc: Mapping[str, str] | None = None,
    split_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64,
) -> DataFrame:
    """A feature table from parquet, or from a database split into key ranges read in parallel."""
    if jdbc is None:
        return spark.read.parquet(path)
    reader = spark.read.format("jdbc").options(**jdbc)
    if split_on is not None and bounds is not None:
        reader = reader.options(partitionColumn=split_on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


FeatureStep = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """User extensions: layers by table name and DataFrame steps by build type."""

    layers: dict[str, LayerSpec] = field(default_factory=lambda: dict(LAYERS))
    steps: dict[str, FeatureStep] = field(default_factory=dict)

    def register_layer(self, spec: LayerSpec) -> None:
        self.layers[spec.table] = spec

    def register_step(self, build_type: str, step: FeatureStep) -> None:
        if build_type in self.steps:
            raise ValueError(f"build type {build_type!r} is already registered")
        self.steps[build_type] = step

    def run(self, build_type: str, features: DataFrame) -> DataFrame:
        if build_type not in self.steps:
            raise ValueError(f"unknown build type {build_type!r}")
        return self.steps[build_type](features)


REGISTRY = Registry()
