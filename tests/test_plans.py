"""What the plans of the queries look like: filters that reach the scan, columns that are read."""

import re

import pytest

import __spark_entry__ as entry

from .conftest import DATA

FILTERED = (
    "flt02_hash_prefix", "flt08_size_range", "flt09_filetype", "flt10_file_clause", "flt22_name_glob", "flt25_archives_and_nested", "srt01_canonical_order",
    "agg29_filetype_facet", "agg41_snapshot_database", "win02_first_of_content", "joi05_known_links", "fun05_folder_and_base", "rec10_directory_tree", "srt03_largest_first",
)


@pytest.mark.parametrize("name", FILTERED)
def test_filters_reach_the_scan_of_files(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "extracted_files.parquet" in line]
    assert scans
    for scan in scans:
        filters = re.search(r"PushedFilters: \[([^\]]*)", scan)[1]
        assert filters.replace("IsNotNull(id)", "").strip(", "), scan
        assert "created_time" not in scan and "loaded_at" not in scan
