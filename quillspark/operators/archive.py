"""Zip archives of text files, in and out."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .chunking import chunk

#: Caps: files, uncompressed and compressed bytes of an archive.
MAX_FILES, MAX_PLAIN, MAX_ZIPPED = 50, 4 << 20, 2 << 20


def _safe(path: str | None) -> bool:
    path = (path or "").replace("\\", "/")
    return bool(path) and not path.startswith("/") and ".." not in path


def pack(df: DataFrame, group: str = "archive_id", max_files: int = MAX_FILES, max_plain: int = MAX_PLAIN, max_zipped: int = MAX_ZIPPED, include_base64: bool = False) -> DataFrame:
    """One row per archive: file_count, uncompressed_bytes, original_tokens, compressed_bytes, archive, error, cache_key, base64.

    Archives beyond a cap carry an error and no bytes; counts are checked before texts are
    gathered, so no task holds more than a cap's worth. Null texts are empty files; a null
    or unsafe path is an error; a null group is an archive of its own.
    """
    body = F.coalesce("text", F.lit(""))
    sized = df.groupBy(group).agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.octet_length(body)).cast("long").alias("uncompressed_bytes"), F.sum(tx.token_count(body)).alias("original_tokens"))
    kind = dict(df.dtypes)[group]

    def zipped(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        bad = [p for p in rows["path"] if not _safe(p)]
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for path, text in sorted(zip(rows["path"], rows["text"], strict=True)) if not bad else ():
                z.writestr(zipfile.ZipInfo(path.replace("\\", "/")), text)
        raw = held.getvalue()
        error = f"unsafe path {bad[0]}" if bad else "too large" if len(raw) > max_zipped else None
        return pd.DataFrame({group: [rows[group].iloc[0]], "compressed_bytes": [len(raw)], "archive": [None if error else raw], "error": [error]})

    fits = sized.where((F.col("file_count") <= max_files) & (F.col("uncompressed_bytes") <= max_plain)).select(F.col(group).alias("fit"))
    kept = df.join(fits, F.col(group).eqNullSafe(F.col("fit")), "left_semi").select(group, "path", body.alias("text"))
    done = kept.groupBy(group).applyInPandas(zipped, f"{group} {kind}, compressed_bytes long, archive binary, error string").withColumnRenamed(group, "of")
    over = F.when(F.col("file_count") > max_files, "too many files").when(F.col("uncompressed_bytes") > max_plain, "too many bytes")
    out = sized.join(done, F.col(group).eqNullSafe(F.col("of")), "left").drop("of").withColumn("error", F.coalesce(over, "error"))
    out = out.withColumn("cache_key", F.concat(F.lit("cache://pack/"), F.left(F.sha2("archive", 256), F.lit(16))))
    return out.withColumn("base64", F.base64("archive")) if include_base64 else out


def _files(raw: bytes, max_files: int, max_plain: int, max_zipped: int) -> list[tuple[str, str]]:
    """Path and text of every file of an archive, all or an error."""
    if len(raw) > max_zipped:
        raise ValueError(f"archive of {len(raw)} bytes exceeds {max_zipped}")
    out, left = [], max_plain
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if len(z.infolist()) > max_files:
            raise ValueError(f"archive of {len(z.infolist())} files exceeds {max_files}")
        for info in z.infolist():
            if info.is_dir():
                continue
            if not _safe(info.filename):
                raise ValueError(f"unsafe path {info.filename}")
            with z.open(info) as f:
                data = f.read(left + 1)
            left -= len(data)
            if left < 0:
                raise ValueError(f"files exceed {max_plain} bytes")
            out.append((info.filename, data.decode("utf-8", "replace")))
    if not out:
        raise ValueError("archive contained no files")
    return out


def unpack(df: DataFrame, archive: str = "archive", key: str = "archive_id", max_files: int = MAX_FILES, max_plain: int = MAX_PLAIN, max_zipped: int = MAX_ZIPPED) -> DataFrame:
    """(key, path, text, error) of every archive; one that is corrupt or beyond a cap gives one row with an error, and no files.

    Sizes are bounded while reading; archives may be bytes or base64 text; null ones give nothing.
    """
    kind = dict(df.dtypes)[key]
    raw = F.col(archive) if dict(df.dtypes)[archive] == "binary" else F.coalesce(F.try_to_binary(F.trim(archive), F.lit("base64")), F.lit(b""))

    def read(batches):
        for rows in batches:
            out = []
            for k, data in zip(rows[key], rows["raw_zip"], strict=True):
                try:
                    out += [(k, path, text, None) for path, text in _files(data, max_files, max_plain, max_zipped)]
                except (ValueError, zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, OSError, zipfile.zlib.error) as e:
                    out.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "path", "text", "error"])

    return df.where(F.col(archive).isNotNull()).select(key, raw.alias("raw_zip")).mapInPandas(read, f"{key} {kind}, path string, text string, error string")


def unpack_chunks(df: DataFrame, archive: str = "archive", key: str = "archive_id", chunk_tokens: int = 512, overlap_tokens: int = 64, **caps) -> DataFrame:
    """Chunks (as of ``chunk``) of every sound archive's files, put together under headings "# file: path"."""
    files = unpack(df, archive, key, **caps).where(F.col("error").isNull())
    body = F.concat(F.lit("# file: "), F.col("path"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    whole = files.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", body.alias("body")))), lambda x: x["body"]), "").alias("corpus"))
    return chunk(whole, "corpus", key, chunk_tokens, overlap_tokens)
