"""Archives: member policy and fan-out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill import errors
from textmill.operators.ordering import BLK, block_of
from textmill.options import Limits
from textmill.session import materialize
from textmill.sources.files import ARCHIVE_EXTENSIONS, SUPPORTED, extension

INNER = "!/"  # Separates an archive from its member in the name of a member.
MANIFEST = "archive string, member string, ordinal int, file_size bigint, flag_bits int, is_dir boolean"
ENCRYPTED = 1  # Fixed value: flag bit of an encrypted member.
FLUSH, FLUSH_BYTES = 1024, 4 << 20  # Members, and bytes of them, handed back to Spark at a time.


def read_manifest(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of ``archives(source_file, content)``, and the errors of unreadable ones."""

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "ordinal", "file_size", "flag_bits", "is_dir", "reason"]
        for batch in batches:
            for name, content in zip(batch["source_file"], batch["content"]):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    found = [(name, i.filename, n, i.file_size, i.flag_bits, i.is_dir(), None) for n, i in enumerate(infos)]
                except Exception as exc:
                    found = [(name, None, 0, 0, 0, False, str(exc))]
                yield pd.DataFrame(found, columns=columns)

    listed = archives.select("source_file", "content").mapInPandas(listing, MANIFEST + ", reason string")
    broken = listed.where(F.col("reason").isNotNull()).select(
        F.col("archive").alias("source_file"),
        F.lit(errors.INVALID_FILE).alias("error_code"),
        errors.invalid_file(F.col("archive"), F.col("reason")).alias("message"),
        F.lit(None).cast("string").alias("detail"),
    )
    return listed.where(F.col("reason").isNull()).drop("reason"), broken


def archive_error(has_password: bool, limits: Limits) -> Column:
    name, size, most = F.col("archive"), F.col("total_size"), limits.max_archive_bytes
    large = [] if most is None else [(size > most, errors.INVALID_FILE, errors.archive_too_large(name, size, most))]
    return errors.first_error(
        ((F.col("encrypted") == 1) & ~F.lit(has_password), errors.ZIP_PASSWORD_REQUIRED, errors.zip_password_required(name)),
        *large,
    )


def archive_policy(
    manifest: DataFrame, has_password: bool = False, limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Members to read, and the errors of refused archives (A10).

    An archive is refused where any member is encrypted and no password is given,
    or where its files add up to more than a limit that is set. Directories, unsupported files and
    nested archives are passed over. The verdict is joined per block of members, so
    one archive with most of the members does not skew the join.
    """
    blocked = manifest.withColumn(BLK, block_of("ordinal"))
    blocks = blocked.groupBy("archive", BLK).agg(
        F.sum(F.when(~F.col("is_dir"), F.col("file_size")).otherwise(0)).alias("size"),
        F.max(F.col("flag_bits").bitwiseAND(F.lit(ENCRYPTED))).alias("enc"),
    )
    whole = blocks.groupBy("archive").agg(F.sum("size").alias("total_size"), F.max("enc").alias("encrypted"))
    good, bad = errors.split_errors(whole, archive_error(has_password, limits), "archive")
    ext = extension(F.col("member"))
    readable = blocked.where(~F.col("is_dir") & ext.isin(*SUPPORTED) & ~ext.isin(*ARCHIVE_EXTENSIONS))
    accepted = blocks.select("archive", BLK).join(good.select("archive"), "archive")
    members = readable.join(accepted, ["archive", BLK], "left_semi").select(
        F.col("archive").alias("container_file"),
        F.col("member").alias("source_file"),
        ext.alias("file_ext"),
        "ordinal",
        "file_size",
    )
    return members, bad


def read_members(
    archives: DataFrame, members: DataFrame, password: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Bytes of the accepted members (A11), and the errors of unreadable ones.

    Members leave their archives in batches of a few megabytes, a larger member alone at the end of one. A member that cannot be read is
    an error of its own; the rest of the archive goes on.
    """
    # Written, so that its size decides whether the archives themselves have to be shuffled.
    wanted = materialize(members.groupBy("container_file").agg(F.collect_set("ordinal").alias("ordinals")))
    secret = password.encode() if password else None

    columns = ["container_file", "source_file", "ordinal", "content", "error_code", "reason"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            for name, content, ordinals in zip(batch["container_file"], batch["content"], batch["ordinals"]):
                infos = zipfile.ZipFile(io.BytesIO(content))
                for n in sorted(ordinals):
                    info = infos.infolist()[n]
                    data, code, reason = None, None, None
                    try:
                        data = infos.read(info, pwd=secret)
                    except Exception as exc:
                        reason = str(exc)
                        code = errors.ZIP_WRONG_PASSWORD if "password" in reason.lower() else errors.INVALID_FILE
                    found.append((name, info.filename, int(n), data, code, reason))
                    held += len(data or b"")
                    if held >= FLUSH_BYTES or len(found) >= FLUSH:
                        yield pd.DataFrame(found, columns=columns)
                        found, held = [], 0
        if found:
            yield pd.DataFrame(found, columns=columns)

    fields = "container_file string, source_file string, ordinal int, content binary, error_code string, reason string"
    opened = archives.select(F.col("source_file").alias("container_file"), "content").join(wanted, "container_file")
    # Written once: several branches go on from here, and unpacking again would cost each of them a full read.
    read = materialize(opened.mapInPandas(extract, fields))
    good = read.where(F.col("error_code").isNull()).select(
        "container_file", "source_file", extension(F.col("source_file")).alias("file_ext"), "ordinal", "content"
    )
    wrong = F.format_string("Wrong password for ZIP file '%s'.", F.col("container_file"))
    bad = read.where(F.col("error_code").isNotNull()).select(
        F.concat("container_file", F.lit(INNER), "source_file").alias("source_file"),
        "error_code",
        F.when(F.col("error_code") == errors.ZIP_WRONG_PASSWORD, wrong)
        .otherwise(errors.invalid_file(F.col("source_file"), F.col("reason")))
        .alias("message"),
        F.lit(None).cast("string").alias("detail"),
    )
    return good, bad
