"""Registered queries against their SQL. VOXLAKE_ALL=1 runs every one; the default is one of each kind."""

import os

import pytest

from tests.compare import connect, differences
from voxlake.plans import catalog

SF_DIR = os.environ.get("VOXLAKE_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "flagship_turn_report", "tx02_normalize_unicode", "tx05_merge_digit_groups", "tx09_word_errors", "tx12_normalize_documents",
    "ag03_bootstrap_ci_by_dataset", "ag06_wer_histograms", "ag12_merge_channels", "sg02_natural_segments", "sg03_caption_cues",
    "wn04_seam_stitch", "wn05_speech_regions", "jn03_assign_speakers", "jn04_remap_compressed", "jn11_duplicate_contents",
    "st06_rate_limit", "st12_wn15_error_alerts", "st02_live_regions", "sc01_sc12_manifest_round_trip", "sg07_restore_readable",
]
NAMES = list(catalog.ORACLES) if os.environ.get("VOXLAKE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, SF_DIR, catalog.QUERIES[name], catalog.ORACLES[name]) == []
