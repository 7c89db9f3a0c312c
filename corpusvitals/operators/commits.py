"""Commit-history summary."""

from pyspark.sql import DataFrame, functions as F


def commit_health(repos: DataFrame, commits: DataFrame, branches: DataFrame) -> DataFrame:
    """Per repository; those without a log have ``is_git = false``.

    Contributors are distinct (name, email) pairs, counted in two steps so
    that a very active repository does not gather them in one task.
    """
    by_author = commits.groupBy("repo_id", "author_name", "author_email").agg(
        F.count("*").alias("n"),
        F.max(F.struct("ts", "commit_id", "author_name", "subject")).alias("last"),
    )
    history = by_author.groupBy("repo_id").agg(
        F.sum("n").alias("n_commits"),
        F.count("*").alias("n_contributors"),
        F.max("last").alias("last"),
    )
    heads = branches.distinct().groupBy("repo_id").agg(F.count("*").alias("n_branches"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        repos.select("repo_id").distinct()
        .join(history, "repo_id", "left")
        .join(heads, "repo_id", "left")
        .select(
            "repo_id",
            F.col("n_commits").isNotNull().alias("is_git"),
            zero("n_commits"), zero("n_branches"), zero("n_contributors"),
            F.col("last.commit_id").alias("last_commit_id"),
            F.col("last.author_name").alias("last_author"),
            F.col("last.subject").alias("last_subject"),
        )
    )
