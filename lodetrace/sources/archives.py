"""Package archives read in memory, member by member, without ever being unpacked to disk."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Limits of an archive; beyond them the archive is refused, not cut.
MOST_BYTES, MOST_FILE, MOST_FILES = 100 << 20, 50 << 20, 20_000


def members(data: bytes, strip: int = 1) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of every regular file of a gzipped tar; `strip` leading parts
    of a path are dropped. Links and devices are passed over. The whole archive is looked
    through first: one that is damaged, holds a path that leaves it or passes a limit gives one
    row that has an error only."""
    if (refused := _refusal(data)) is not None:
        yield refused[0], None, refused[1]
        return
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as tar:
        for m in tar:
            path = "/".join(posixpath.normpath(m.name).split("/")[strip:])
            if m.isfile() and path:
                yield path, tar.extractfile(m).read(), None


def _refusal(data: bytes) -> tuple[str, str] | None:
    """(member, reason) if an archive is refused; its files are passed over, not kept."""
    total = count = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                path = posixpath.normpath(m.name)
                if path.startswith(("/", "../")) or path == ".." or "\x00" in m.name:
                    return m.name, "path leaves the archive"
                total, count = total + m.size, count + 1
                if m.size > MOST_FILE or total > MOST_BYTES or count > MOST_FILES:
                    return m.name, "limit passed"
    except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
        return "", f"unreadable: {type(e).__name__}"
    return None


def package_files(archives: DataFrame) -> DataFrame:
    """archives(ref, content) as (ref, path, content, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ref, data in zip(pdf["ref"], pdf["content"]):
                if data is not None:
                    yield pd.DataFrame([(ref, *m) for m in members(data)], columns=["ref", "path", "content", "error"])

    return archives.select("ref", "content").mapInPandas(run, "ref string, path string, content binary, error string")
