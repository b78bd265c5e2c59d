"""Facts of repositories from their file listings (``repo, path, content``).

Candidates come from small tables with an order; the first that a repository has wins, by
``min_by`` in one combined aggregation, so there is a single shuffle by repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates in order of priority.
MANIFESTS = ("bower.json", "package.json")
BUILD_FILES = (("webpack.config.js", "webpack"), ("gulpfile.js", "gulp"), ("Gruntfile.js", "grunt"), ("gruntfile.js", "grunt"))
TEST_FILES = ("karma.conf.js", "test/karma.conf.js", "config/karma.conf.js")
BROWSERS = r"""\bbrowsers\s*:\s*\[([^\]]*)\]"""
PHANTOM = r"""(['"])PhantomJS\1"""


def first_by(rank: Column, value: Column) -> Column:
    """The value of the smallest rank that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), rank))


def rank_of(path: Column, candidates: tuple[str, ...]) -> Column:
    at = F.array_position(F.lit(list(candidates)), path)
    return F.when(at > 0, at)


def framework_version(content: Column) -> Column:
    """The version under ``dependencies`` or else ``devDependencies``; an empty one counts, malformed JSON has none."""
    return F.coalesce(F.get_json_object(content, "$.dependencies.angular"), F.get_json_object(content, "$.devDependencies.angular"))


def repository_facts(listing: DataFrame) -> DataFrame:
    """``repo, version, version_source, build_tool, test_config, uses_phantom`` for every repository."""
    path, content = F.col("path"), F.col("content")
    manifest, build, test = rank_of(path, MANIFESTS), rank_of(path, tuple(p for p, _ in BUILD_FILES)), rank_of(path, TEST_FILES)
    version = F.when(manifest.isNotNull(), framework_version(content))
    tool = F.get(F.lit([t for _, t in BUILD_FILES]), build.cast("int") - 1)
    phantom = F.regexp_extract(content, BROWSERS, 1).rlike(PHANTOM)
    return listing.groupBy("repo").agg(
        first_by(manifest, version).alias("version"),
        first_by(manifest, F.when(version.isNotNull(), path)).alias("version_source"),
        F.coalesce(first_by(build, tool), F.lit("none")).alias("build_tool"),
        first_by(test, F.when(test.isNotNull(), path)).alias("test_config"),
        F.coalesce(first_by(test, F.when(test.isNotNull(), phantom)), F.lit(False)).alias("uses_phantom"),
    )


def without_phantom(config: Column, browser: str = "ChromeHeadless") -> Column:
    """A test configuration with the browser replaced where it is listed, in the same quotes."""
    listed = F.regexp_extract(config, BROWSERS, 0)
    fixed = F.regexp_replace(listed, PHANTOM, f"$1{browser}$1")
    return F.when(listed.rlike(PHANTOM), F.replace(config, listed, fixed)).otherwise(config)
