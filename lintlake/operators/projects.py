"""Project listing, type detection and dashboard rows, on the unfiltered files table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.operators.scoring import _chain


def portfolio_repos(repos: DataFrame, skip: list[str], limit: int = 100) -> DataFrame:
    """First ``limit`` repos by name, then without the skipped ones."""
    return repos.select("repo").orderBy("repo").limit(limit).filter(~F.col("repo").isin(skip))


def scan_projects(listing: DataFrame) -> DataFrame:
    """``listing(path)`` of a projects folder -> (project, name, is_git).

    Every first-level folder is a project. A folder that is not under git also contributes its
    sub-folders that are. Path prefixes are reduced map-side to one row per folder.
    """
    parts = F.split("path", "/", -1)
    top, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    inside = listing.select(
        top.alias("top"), second.alias("second"), third.alias("third"), F.size(parts).alias("depth")
    ).filter(
        (F.col("depth") > 1) & ~F.col("top").startswith(".") & ~F.col("top").isin(fv.PROJECT_SKIP_NAMES)
    )
    first = inside.groupBy("top").agg(F.bool_or(F.col("second") == ".git").alias("is_git"))
    nested = (
        inside.filter(F.col("depth") > 2)
        .groupBy("top", "second")
        .agg(F.bool_or(F.col("third") == ".git").alias("is_git"))
        .filter("is_git")
        .join(first.filter("is_git").select("top"), "top", "left_anti")
    )
    return first.select(F.col("top").alias("project"), F.col("top").alias("name"), "is_git").unionByName(
        nested.select(F.concat_ws("/", "top", "second").alias("project"),
                      F.col("second").alias("name"), "is_git")
    )


def last_commits(commits: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Date, message and branch of the last commit of each git repo, and whether it has open changes."""
    order = F.struct("commit_ts", "commit_id")
    last = commits.filter("is_git").groupBy("repo").agg(
        F.max_by(F.struct("commit_ts", "message", "branch"), order).alias("last")
    ).select(
        "repo",
        F.substring(F.col("last.commit_ts").cast("string"), 1, 10).alias("last_commit_date"),
        F.col("last.message").alias("last_commit_msg"),
        F.col("last.branch").alias("branch"),
    )
    if changes is None:
        return last.withColumn("has_uncommitted", F.lit(False))
    dirty = changes.groupBy("repo").agg((F.count(F.lit(1)) > 0).alias("has_uncommitted"))
    return last.join(dirty, "repo", "left").na.fill(False, ["has_uncommitted"])


def recent_projects(projects: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Projects with a commit since the cut-off date, and all that are not under git."""
    cutoff = F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")
    return projects.filter((F.coalesce("last_commit_date", F.lit("")) >= cutoff) | ~F.col("is_git"))


def file_contains(path: Column, content: Column, size: Column, needle: str) -> Column:
    """A root-level Python file below the probe size holds the text."""
    return F.bool_or(
        text.is_root(path) & path.endswith(".py") & (size < fv.PROBE_MAX_BYTES) & content.contains(needle)
    )


def project_facts(files: DataFrame) -> DataFrame:
    """Booleans per repo in one hash aggregate."""
    path, content, size = F.col("path"), F.col("content"), F.col("size")
    has = lambda *names: F.bool_or(path.isin(*names))
    under = lambda folder: F.bool_or(path.startswith(folder + "/"))
    root_with = lambda ext: F.bool_or(text.is_root(path) & (text.suffix(path) == ext))
    probe = lambda needle: file_contains(path, content, size, needle)
    return files.groupBy("repo").agg(
        has("next.config.ts", "next.config.js").alias("nextjs"),
        has("vite.config.js", "vite.config.ts").alias("vite"),
        has("package.json").alias("package_json"),
        under("apps").alias("apps"),
        under("node_modules").alias("node_modules"),
        has("pyproject.toml", "setup.py").alias("packaging"),
        has("app.py").alias("app_py"),
        has("requirements.txt").alias("requirements"),
        F.bool_or((path == "requirements.txt") & content.contains("streamlit")).alias("streamlit"),
        (probe("from fastapi") | probe("import fastapi")).alias("fastapi"),
        (probe("from flask") | probe("import flask")).alias("flask"),
        root_with(".py").alias("root_py"),
        has("docker-compose.yml", "Dockerfile").alias("docker"),
        has("index.html").alias("index_html"),
        root_with(".ps1").alias("root_ps1"),
    )


_RULES = {
    "nextjs": lambda c: c("nextjs"),
    "vite-react": lambda c: c("vite"),
    "node-monorepo": lambda c: c("package_json") & c("apps"),
    "python-package": lambda c: c("packaging"),
    "streamlit": lambda c: c("app_py") & c("streamlit"),
    "fastapi": lambda c: c("fastapi"),
    "flask": lambda c: c("flask"),
    "python-script": lambda c: c("root_py"),
    "docker": lambda c: c("docker"),
    "static-site": lambda c: c("index_html"),
    "powershell-scripts": lambda c: c("root_ps1"),
}


def detect_projects(files: DataFrame) -> DataFrame:
    """Type and launch attributes per repo; the first rule that holds decides."""
    types = [row[0] for row in fv.PROJECT_TYPES]
    kind = _chain([(_RULES[t](F.col), F.lit(t)) for t in types], F.lit("unknown"))
    attribute = lambda i: _chain(
        [(F.col("project_type") == row[0], F.lit(row[i]).cast("string")) for row in fv.PROJECT_TYPES],
        F.lit(None).cast("string"),
    )
    needs_install = (
        F.when(F.col("project_type").isin("nextjs", "vite-react", "node-monorepo"), ~F.col("node_modules"))
        .when(F.col("project_type").isin("python-package", "streamlit", "fastapi", "flask"), True)
        .when(F.col("project_type") == "python-script", F.col("requirements"))
        .otherwise(False)
    )
    return (
        project_facts(files)
        .withColumn("project_type", kind)
        .select(
            "repo", "project_type",
            attribute(1).alias("install_command"), attribute(2).alias("launch_command"),
            needs_install.alias("needs_install"), attribute(3).alias("port"),
        )
        .withColumn(
            "status",
            F.when(F.col("project_type") == "unknown", "not_scanned")
            .when(F.col("launch_command").isNotNull(), "ready")
            .otherwise("not_launchable"),
        )
    )


def launchable(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("launch_command").isNotNull() & (F.col("status") == "ready"))


def by_name(projects: DataFrame, name: str, column: str = "repo") -> DataFrame:
    return projects.filter(F.lower(column) == name.lower())


def dashboard_summary(projects: DataFrame) -> DataFrame:
    return projects.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_git").alias("git_repos"),
        F.count_if(F.col("launch_command").isNotNull()).alias("launchable"),
        F.count_if("has_uncommitted").alias("uncommitted"),
    )


def session_summary(projects: DataFrame) -> DataFrame:
    return projects.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "launched").alias("launched"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.coalesce("review", F.lit("")) != "").alias("reviewed"),
    )
