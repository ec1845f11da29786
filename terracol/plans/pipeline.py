"""Stages of the pavement flow as compositions of operators. A stage of one's own is ``df.transform(fn)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracol.functions.columns import gray_mask, nan_nonpositive, no_nan
from terracol.functions.session import materialised
from terracol.operators import aggregates as A
from terracol.operators import graph as G
from terracol.operators import joins as J
from terracol.operators import raster as R
from terracol.sources import tables as S


@dataclass
class Scene:
    """An image (row, col, lon, lat, bands), its road cells, and survey points (idx, lon, lat, pci, seg_id)."""

    pixels: DataFrame
    roads: DataFrame
    points: DataFrame
    height: int
    width: int


def pci_proximity(scene: Scene, *, merge: float = 50e-5, near: float = 50e-5, method: str = "mean_min") -> DataFrame:
    """Survey values on road cells near survey points: merge close points, take road cells near a merged one, close gaps,
    give each cell the value of the nearest point as given. Cells of value 0 are background and go."""
    merged = materialised(J.merge_close_points(scene.points, merge, method)).select(F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    places = scene.pixels.select("row", "col", F.col("lon").alias("lx"), F.col("lat").alias("ly"))
    close = R.mask_and(J.near_any(places, merged, near), scene.roads)
    mask = R.morph_close(close, R.disk(3), scene.height, scene.width)
    wanted = places.join(mask, ["row", "col"]).withColumn("cell", F.col("row") * scene.width + F.col("col"))
    given = scene.points.select("idx", "pci", F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    return J.nearest(wanted, given, "cell", ["idx"]).where("pci IS NULL OR pci <> 0").select("row", "col", F.col("pci").alias("value"))


def snap_points(points: DataFrame, pixels: DataFrame, roads: DataFrame) -> DataFrame:
    """(idx, row, col): each point's nearest pixel by coordinates, moved to the road cell nearest to it by rows and columns."""
    places = points.select("idx", F.col("lon").alias("lx"), F.col("lat").alias("ly"))
    grid = pixels.select("row", "col", F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    at = J.nearest(places, grid, "idx", ["row", "col"]).select("idx", F.col("row").cast("double").alias("ly"), F.col("col").cast("double").alias("lx"))
    cells = roads.select("row", "col", F.col("row").cast("double").alias("ry"), F.col("col").cast("double").alias("rx"))
    return J.nearest(at, cells, "idx", ["row", "col"]).select("idx", "row", "col")


def segment_pairs(scene: Scene) -> DataFrame:
    """(pair_id, seg_id, pci, r0, c0, r1, c1): points followed by one of their segment, both moved to the road; the pair
    has the first one's idx and value."""
    pairs = materialised(J.consecutive_pairs(scene.points))
    used = pairs.select("idx").union(pairs.select(F.col("next_idx").alias("idx"))).distinct()
    ends = materialised(snap_points(scene.points.join(used, "idx", "left_semi"), scene.pixels, scene.roads))
    a, b = ends.toDF("idx", "r0", "c0"), ends.toDF("next_idx", "r1", "c1")
    out = pairs.join(a, "idx").join(b, "next_idx").join(scene.points.select("idx", "pci"), "idx")
    return out.select(F.col("idx").alias("pair_id"), "seg_id", "pci", "r0", "c0", "r1", "c1")


def pci_segments(scene: Scene) -> tuple[DataFrame, DataFrame]:
    """Segment ids burnt along shortest road paths between consecutive points (of crossing pairs the later wins), and
    the segments' values (seg_id, pci)."""
    pairs = materialised(segment_pairs(scene))
    return G.segment_burn(G.shortest_paths(scene.roads, G.last_of_routes(pairs)), pairs)


def enhance(labels: DataFrame, rgb: DataFrame, height: int, width: int, *, grow: int = 10, gray_threshold: float | None = None, white: float = 0.92, grad_threshold: float | None = None, shift: int = 20, compat: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Grow the labels; keep them on asphalt-coloured cells after a move; drop steep cells near the labels given. Returns
    the labels and the move (one row dy, dx; None without one). A threshold of None or below 0 skips its step, and
    without the first one no cell is steep.

    The move is the one that brings the asphalt-coloured cells best onto the grown labels. With ``compat`` (the published
    flow) a grown cell stays where it is asphalt-coloured and the labels, rolled dx rows and dy columns, cover it;
    without, where the asphalt-coloured cells moved by dy rows and dx columns do."""
    grown = R.morph_multiclass(labels, R.square(grow), "dilation", height, width).withColumn("value", nan_nonpositive(F.col("value")))
    if gray_threshold is None or gray_threshold < 0:
        return grown, None
    grown = materialised(grown)
    gray = rgb.where(gray_mask(F.col("r"), F.col("g"), F.col("b"), gray_threshold, white)).select("row", "col")
    offset = materialised(R.best_offset(grown, gray, shift))
    if compat:
        rolled = R.apply_offset(grown.select("row", "col"), offset.select(F.col("dx").alias("dy"), F.col("dy").alias("dx")), height, width)
        kept = R.mask_and(rolled, gray)
    else:
        kept = R.apply_offset(gray, offset, height, width)
    out = grown.join(kept, ["row", "col"], "left_semi")
    if grad_threshold is not None and grad_threshold >= 0:
        out = R.grad_object_removal(rgb, out, height, width, grad_threshold, gate=labels)
    return out.where("value IS NOT NULL"), offset


def crop_scene(scene: Scene, offset: DataFrame) -> Scene:
    """All layers without the border that the move leaves undefined; points stay."""
    move = offset.first()
    cut = [R.crop_by_offset(df, offset, scene.height, scene.width) for df in (scene.pixels, scene.roads)]
    return Scene(*cut, scene.points, scene.height - abs(move["dy"]), scene.width - abs(move["dx"]))


def region_frames(regions: DataFrame, members: DataFrame, crop: int) -> tuple[DataFrame, DataFrame]:
    """Each region's pixels folded into a crop x crop frame (region, r, c, bands), and the frame's labels (region, r, c,
    label): the region's where its first band is not 0, else 0."""
    own = members.join(regions.select("region", "min_row", "min_col"), "region")
    cells = own.select("region", (F.col("row") - F.col("min_row")).alias("row"), (F.col("col") - F.col("min_col")).alias("col"), "bands")
    sizes = regions.select("region", (F.col("max_row") - F.col("min_row")).alias("height"), (F.col("max_col") - F.col("min_col")).alias("width"))
    frames = R.fold_to_frame(cells, sizes, crop)
    return frames, R.region_label_raster(frames, regions.select("region", F.col("label").cast("double").alias("label")))


def prepare_patches(pixels: DataFrame, segments: DataFrame, lut: DataFrame | None, height: int, width: int, crop: int, overlap: float, fill: int = 0) -> dict[str, DataFrame]:
    """Regions with their pixels, frames and label rasters, and overlapping patches of road pixels: ``bands``,
    ``labeled_bands``, ``label``. Patches without a label go.

    With a lookup the label comes first: a segment that it doesn't hold has label ``fill``, and its pixels are road only
    if that is above 0. So both stacks of bands hold the same cells."""
    regions, members = G.process_labeled_image(segments, pixels, lut, 1, height, width)
    frames, frame_labels = region_frames(regions, members, crop)
    ids = segments.where("value > 0").select("row", "col", F.col("value").cast("double").alias("seg_id"))
    if lut is None:
        labels, fill = ids.select("row", "col", F.col("seg_id").cast("int").alias("label"), F.lit(True).alias("road")), 0
    else:
        labels = J.lookup_labels(ids, lut.select(F.col("seg_id").cast("double").alias("seg_id"), "pci"), fill).select("row", "col", "label", (F.col("label") > 0).alias("road"))
    joined = pixels.join(labels, ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(fill))).withColumn("road", F.coalesce("road", F.lit(fill > 0)))
    on = joined.withColumn("bands", F.transform("bands", lambda x: F.when(F.col("road"), F.coalesce(no_nan(x), F.lit(0.0))).otherwise(0.0))).drop("road").withColumn("labeled_bands", F.col("bands"))
    patches = R.tile_patches(materialised(on), height, width, crop, overlap)  # they are cut twice: once for what has a label
    kept = R.drop_empty_patches(patches, patches.withColumn("value", F.col("label")))
    return {"regions": regions, "region_pixels": members, "region_frames": frames, "region_labels": frame_labels, "patches": kept.select("patch_id", "r", "c", "bands", "labeled_bands", "label")}


def write_prepared(outputs: dict[str, DataFrame], path: str, roi: tuple, source: int) -> None:
    """The five aligned tables: region frames and their labels, patches of all roads, of labels, of labelled roads."""
    p, key = outputs["patches"], ["patch_id", "r", "c"]
    tables = {"region_frames": outputs["region_frames"], "region_labels": outputs["region_labels"], "road_patches": p.select(*key, "bands"), "label_patches": p.select(*key, "label"), "labeled_patches": p.select(*key, F.col("labeled_bands").alias("bands"))}
    S.write_patches(tables, path, roi, source)


def pavement_pipeline(scene: Scene, roi: tuple, *, crop: int, overlap: float, segments: bool = False, p95: bool = False, method: str = "mean_min", path: str | None = None, source: int = 0, **thresholds) -> dict[str, DataFrame]:
    """ROI crop, normalised bands, labels from the survey (with ``segments`` along its segments, else around its points),
    their enhancement where thresholds (see enhance) are given, patches; with ``path`` these are written too."""
    rect = materialised(R.crop_rect(scene.pixels, roi))
    r = rect.first()
    if r["y0"] is None:
        raise ValueError("the region of interest holds no pixel")
    pixels = R.crop_to(scene.pixels, rect)
    pixels = materialised(A.normalize_bands_max(A.normalize_p95(pixels) if p95 else pixels))  # each step below reads them
    part = Scene(pixels, materialised(R.crop_to(scene.roads, rect)), scene.points, r["y1"] - r["y0"], r["x1"] - r["x0"])
    if segments:
        cells, lut = pci_segments(part)
        labels = cells.select("row", "col", F.col("seg_id").cast("double").alias("value"))
    else:
        labels, lut = pci_proximity(part, method=method), None
    labels = materialised(labels)
    if thresholds:
        rgb = part.pixels.select("row", "col", *[F.get("bands", F.lit(i)).alias(n) for i, n in enumerate("rgb")])
        labels, offset = enhance(labels, rgb, part.height, part.width, **thresholds)
        if offset is not None:
            labels = R.crop_by_offset(labels, offset, part.height, part.width)
            part = crop_scene(part, offset)
        labels = materialised(labels)
    out = {"labels": labels, **prepare_patches(part.pixels.select("row", "col", "bands"), labels, lut, part.height, part.width, crop, overlap)}
    if path:
        write_prepared(out, path, roi, source)
    return out
