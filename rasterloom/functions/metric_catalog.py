"""The metric catalogue: what a metric measures, which way is better, its tolerances and its target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Key, job, better, ideal, sigma of a preview, sigma of an export, relative, target limit, target relative to, target where.
METRICS = (
    ('de00_mean', 'resembles', 'lower', None, 0.069, 0.073, True, None, None, None),
    ('de00_p95', 'resembles', 'lower', None, 0.073, 0.12, True, None, None, None),
    ('ssim', 'resembles', 'higher', None, 0.0066, 0.007, False, None, None, None),
    ('regions', None, None, None, None, None, False, None, None, None),
    ('background_regions', None, None, None, None, None, False, None, None, None),
    ('labeled_area_fraction', 'paintable', 'higher', None, 0.024, 0.0064, False, None, None, None),
    ('unlabeled_regions', 'paintable', 'lower', None, 69.0, 18.0, False, 0.0, None, None),
    ('sliver_area_fraction', 'paintable', 'lower', None, 0.015, 0.014, False, 0.01, None, None),
    ('gradient_sliver_fraction', 'paintable', 'lower', None, 0.00017, 0.00014, False, 0.01, None, None),
    ('band_regions', None, None, None, None, None, False, None, None, None),
    ('small_label_fraction', 'paintable', 'lower', None, 0.021, 0.022, False, 0.0, None, None),
    ('labels_on_lines', 'paintable', 'lower', None, 0.0, 0.0, False, 0.0, None, None),
    ('overlapping_labels', 'paintable', 'lower', None, 0.0, 0.0, False, 0.0, None, None),
    ('leader_labels', None, None, None, None, None, False, None, None, None),
    ('compactness_p10', 'paintable', 'higher', None, 0.023, 0.02, False, None, None, None),
    ('compactness_median', 'paintable', 'higher', None, 0.036, 0.029, False, None, None, None),
    ('lines_per_boundary', 'clean drawing', None, 1.0, 0.1, 0.048, False, None, None, None),
    ('lines_per_boundary_clear', 'clean drawing', None, 1.0, 0.1, 0.048, False, 0.05, None, None),
    ('unenclosed_area_fraction', 'clean drawing', 'lower', None, 0.0, 0.0, False, 0.0, None, None),
    ('same_color_boundary_fraction', 'clean drawing', 'lower', None, 0.028, 0.014, False, 0.0, None, None),
    ('jaggedness', 'clean drawing', 'lower', None, 0.0085, 0.011, False, 1.02, None, None),
    ('edge_f1', 'clean drawing', 'higher', None, 0.023, 0.02, False, None, None, None),
    ('colors_used', None, None, None, None, None, False, None, None, None),
    ('palette_margin_de00', None, None, None, None, None, False, None, None, None),
    ('palette_min_de00', 'palette', 'higher', None, 1.3, 0.93, False, 0.0, 'palette_margin_de00', None),
    ('palette_close_pairs', 'palette', 'lower', None, 3.2, 3.1, False, None, None, None),
    ('ink_line_f1', 'clean drawing', 'higher', None, 0.021, 0.023, False, None, None, None),
    ('ink_print_recall', 'clean drawing', 'higher', None, 0.0015, 0.0034, False, 0.95, None, None),
    ('ink_print_precision', 'clean drawing', 'higher', None, 0.0021, 0.0038, False, 0.95, None, 'ink_reference_exact'),
    ('tube_regions', 'clean drawing', 'lower', None, 2.6, 1.9, False, 0.0, None, None),
    ('tube_ink_fraction', 'clean drawing', 'lower', None, 0.031, 0.028, False, None, None, None),
    ('flat_color_de00_mean', 'palette', 'lower', None, 1.2, 0.81, False, 2.5, 'flat_color_de00_best', 'flat_color_reference_exact'),
    ('flat_color_de00_best', None, None, None, None, None, False, None, None, None),
    ('ink_found_fraction', None, None, None, None, None, False, None, None, None),
    ('ink_found_recall', None, 'higher', None, 0.00042, 0.0046, False, 0.95, None, None),
    ('ink_found_precision', None, 'higher', None, 0.0023, 0.0047, False, 0.95, None, 'ink_reference_exact'),
    ('stray_ink_fraction', None, 'lower', None, 0.0, 0.0, False, 0.0, None, None),
    ('faces_found', None, None, None, None, None, False, None, None, None),
    ('face_found_recall', None, 'higher', None, 0.0, 0.0, False, 1.0, None, None),
    ('stray_faces', None, 'lower', None, 0.0, 0.0, False, 0.0, None, None),
    ('face_de00_mean', 'resembles', 'lower', None, 0.078, 0.082, True, None, None, None),
    ('face_ssim', 'resembles', 'higher', None, 0.016, 0.038, False, None, None, None),
    ('features_lost', 'resembles', 'lower', None, 0.35, 0.29, False, 0.0, None, None),
    ('labels_on_features', 'clean drawing', 'lower', None, 1.6, 3.6, False, None, None, None),
    ('face_regions', None, None, None, None, None, False, None, None, None),
    ('subject_de00_mean', 'resembles', 'lower', None, 0.054, 0.041, True, None, None, None),
    ('subject_ssim', 'resembles', 'higher', None, 0.0047, 0.01, False, None, None, None),
    ('subject_density_ratio', None, None, None, None, None, False, None, None, None),
    ('text_lines_found', None, None, None, None, None, False, None, None, None),
    ('text_found_recall', None, 'higher', None, 0.0023, 0.00073, False, 0.9, None, None),
    ('stray_text_lines', None, 'lower', None, 0.0, 0.0, False, 0.0, None, None),
    ('text_cer_source', None, None, None, None, None, False, None, None, None),
    ('text_cer_page', 'clean drawing', 'lower', None, 0.017, 0.018, False, 0.1, 'text_cer_source', None),
    ('text_cer_painting', 'resembles', 'lower', None, 0.0096, 0.017, False, None, None, None),
    ('labels_on_text', 'clean drawing', 'lower', None, 1.3, 2.7, False, 0.0, None, None),
    ('undersized_regions', 'paintable', 'lower', None, 0.0, 0.0, False, None, None, None),
    ('ink_fraction', None, None, None, None, None, False, None, None, None),
)
_SCHEMA = "metric string, job string, better string, ideal double, sigma_preview double, sigma_export double, relative boolean, limit_ double, relative_to string, where_ string"


def metrics(spark: SparkSession) -> DataFrame:
    """The catalogue as a relation; it has a fixed number of rows."""
    return spark.createDataFrame(METRICS, _SCHEMA)


def sql_metrics() -> str:
    """The catalogue as a SQL relation `metric`."""

    def text(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else f"'{v}'"

    rows = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in METRICS)
    names = ", ".join(c.split(" ")[0] for c in _SCHEMA.split(", "))
    return f"metric AS (SELECT * FROM (VALUES {rows}) AS m({names}))"
