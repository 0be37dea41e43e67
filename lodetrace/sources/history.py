"""Version-control patch logs and project files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.packages import extension, glob_regex
from ..operators.relational import fill_forward

#: Folders a project scan leaves out.
SKIPPED = ["node_modules", ".git", "dist", "build", "coverage", ".venv", "vendor"]


def patch_lines(log: DataFrame) -> DataFrame:
    """(repo, seq, commit, file, line_no, text) of every line a patch log adds.

    `log` has repo, seq and line of `git log -p -U0` output, where a commit starts with
    `commit <hash>`. Commit and file are carried forward in order within a repository; the
    line number starts at each hunk's new position and grows by one with every added line.
    """
    line = F.col("line")
    commit = F.when(line.rlike(r"^commit [0-9a-f]{7,64}"), F.regexp_extract(line, r"^commit ([0-9a-f]+)", 1))
    file = F.when(line.startswith("+++ b/"), F.substring(line, 7, 1 << 30)).when(line.startswith("+++ /dev/null"), F.lit("")).when(commit.isNotNull(), F.lit(""))
    hunk = F.when(line.rlike(r"^@@ "), F.regexp_extract(line, r"^@@ -\S+ \+(\d+)", 1).cast("int"))
    marked = log.select("repo", "seq", "line", commit.alias("commit"), file.alias("file"), hunk.alias("hunk"), F.when(line.rlike(r"^@@ "), F.col("seq")).alias("hunk_seq"))
    filled = fill_forward(marked, ["repo"], ["seq"], ["commit", "file", "hunk", "hunk_seq"])
    counted = line.startswith("+") & ~line.startswith("+++ ") | line.startswith(" ")
    w = Window.partitionBy("repo", "hunk_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = filled.withColumn("line_no", F.col("hunk") + F.coalesce(F.count_if(counted).over(w), F.lit(0)))
    added = line.startswith("+") & ~line.startswith("+++ ")
    return numbered.where(added & (F.col("file") != "") & F.col("hunk").isNotNull()).select("repo", "seq", "commit", "file", F.col("line_no").cast("int").alias("line_no"), F.substring(line, 2, 1 << 30).alias("text"))


def read_patch_log(spark: SparkSession, path: str) -> DataFrame:
    """(repo, seq, line) of patch-log files, one file a repository. A file is read whole, as
    the order of its lines matters."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("repo"), "value")
    return t.select("repo", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))


def first_seen(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the matches with equal keys, in the order of (repo, seq)."""
    from ..operators.relational import keep_first

    return keep_first(matches, keys, F.col("seq"))


def read_files(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None, most_chars: int = 1 << 20) -> DataFrame:
    """(path, content, error) of files below `root`, without skipped folders and ignored globs;
    paths are relative to `root`. A file of more than `most_chars` characters, or with NUL
    bytes, has an error in place of its content; the content of one that is too long in any
    encoding is never loaded."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    b = b.withColumn("path", F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", "\\.") + "/", ""))
    b = b.where(~F.col("path").rlike(r"(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    if extensions:
        b = b.where(extension(F.col("path")).isin(extensions))
    for g in ignore or []:
        b = b.where(~F.col("path").rlike(glob_regex(g)))
    long = F.lit("too long")
    above = b.where(F.col("length") > 4 * most_chars).select("path", F.lit(None).cast("string").alias("content"), long.alias("error"))
    t = b.where(F.col("length") <= 4 * most_chars).select("path", F.col("content").alias("b"))
    t = t.select("path", F.when(F.position(F.lit(b"\x00"), F.col("b")) > 0, F.lit("holds NUL bytes")).alias("error"), F.decode("b", "UTF-8").alias("content"))
    t = t.withColumn("error", F.coalesce("error", F.when(F.length("content") > most_chars, long)))
    return t.select("path", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error").unionByName(above)


def ignore_globs(text: str) -> list[str]:
    """The globs of an ignore file: no blanks, no comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]
