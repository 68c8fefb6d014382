import pytest

from tripweave.config import BuildSettings, EvaluationSettings, ProjectSettings, SampleSettings


@pytest.mark.parametrize(
    "bad",
    [
        {"length_policy": "pad"},
        {"min_duration_seconds": -1},
        {"max_duration_seconds": 0.5},
        {"min_points": 1},
        {"min_distance_m": 5.0, "max_distance_m": 5.0},
        {"max_segment_speed_kmh": 0},
        {"endpoint_tolerance_m": -1},
        {"coordinate_decimals": 13},
        {"include_vins": ("a",), "exclude_vins": ("a",)},
    ],
)
def test_build_limits(bad):
    with pytest.raises(ValueError):
        BuildSettings(**bad)


@pytest.mark.parametrize(
    "bad",
    [
        {"prefix_fractions": ()},
        {"prefix_fractions": (1.0,)},
        {"prefix_fractions": (0.1, 0.1)},
        {"test_vin_fraction": 0.5},
        {"test_vin_fraction": 0.45, "validation_vin_fraction": 0.45},
        {"grid_cell_degrees": 0},
        {"max_history_trips": -1},
        {"max_trajectory_points": 1},
    ],
)
def test_sample_limits(bad):
    with pytest.raises(ValueError):
        SampleSettings(**bad)


def test_mapping_rejects_unknown_keys_at_both_levels():
    with pytest.raises(ValueError, match="speed"):
        ProjectSettings.from_mapping({"speed": 1})
    with pytest.raises(ValueError, match="fast"):
        ProjectSettings.from_mapping({"build": {"fast": True}})
    with pytest.raises(ValueError):
        EvaluationSettings(top_k=())


def test_fingerprint_is_stable_and_sensitive():
    one = ProjectSettings.from_mapping({"build": {"min_points": 3}, "samples": {"prefix_fractions": [0.0]}})
    assert one.samples.prefix_fractions == (0.0,)
    assert len(one.fingerprint) == 64
    assert one.fingerprint != ProjectSettings().fingerprint
    assert ProjectSettings().fingerprint == ProjectSettings().fingerprint
