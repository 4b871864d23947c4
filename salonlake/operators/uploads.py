"""Upload manifest checks (file bytes themselves live in an object store,
outside this library) and linking accepted files to their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the upload rules.
AVATAR_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")
RECEIPT_TYPES = ("image/jpeg", "image/png", "application/pdf")
AVATAR_MAX_BYTES = 5 * 1024 * 1024
RECEIPT_MAX_BYTES = 10 * 1024 * 1024
KV_FALLBACK_MAX_BYTES = 1024 * 1024


def check_uploads(manifest: DataFrame, has_bucket: bool = True, has_kv: bool = False) -> DataFrame:
    """Per upload: ``reason`` (NULL when accepted), storage ``target``
    (bucket / kv / NULL) and the stored ``file_key`` kind-id-millis.ext."""
    kind, mime, size = F.col("kind"), F.col("mime"), F.col("size_bytes")
    avatar, receipt = kind == "avatar", kind == "receipt"
    # An unknown kind, type or size never passes.
    in_types = F.coalesce(F.when(avatar, mime.isin(*AVATAR_TYPES)).when(receipt, mime.isin(*RECEIPT_TYPES)), F.lit(False))
    reason = (F.when(F.col("file_name").isNull(), F.lit("missing_file"))
               .when(receipt & F.col("transaction_id").isNull(), F.lit("missing_transaction"))
               .when(~F.coalesce(avatar | receipt, F.lit(False)), F.lit("unknown_kind"))
               .when(~in_types, F.lit("bad_type"))
               .when(size.isNull(), F.lit("unknown_size"))
               .when(avatar & (size > AVATAR_MAX_BYTES), F.lit("too_large"))
               .when(receipt & (size > RECEIPT_MAX_BYTES), F.lit("too_large")))
    if has_bucket:
        target = F.lit("bucket")
    elif has_kv:
        target = F.when(avatar & (size < KV_FALLBACK_MAX_BYTES), F.lit("kv"))
    else:
        target = F.lit(None).cast("string")
    reason = F.coalesce(reason, F.when(target.isNull(), F.lit("storage_unavailable")))
    ext = F.element_at(F.split(F.col("file_name"), r"\."), -1)
    owner = F.when(avatar, F.col("user_id")).otherwise(F.col("transaction_id"))
    key = F.concat_ws("-", kind, owner.cast("string"), F.col("uploaded_ms").cast("string"))
    return manifest.select("*", reason.alias("reason"),
                           F.when(reason.isNull(), target).alias("target"),
                           F.when(reason.isNull(), F.concat(key, F.lit("."), ext)).alias("file_key"))


def attach_uploads(table: DataFrame, checked: DataFrame, kind: str, owner_col: str,
                   url_col: str) -> DataFrame:
    """Set ``url_col`` = /files/<key> from accepted bucket uploads of ``kind``
    (the latest upload per owner wins)."""
    ok = (checked.where((F.col("kind") == kind) & (F.col("target") == "bucket"))
          .groupBy(F.col(owner_col).alias("_oid"))
          .agg(F.max_by("file_key", "uploaded_ms").alias("_key")))
    j = table.join(ok, table["id"] == ok["_oid"], "left")
    url = F.when(F.col("_key").isNotNull(), F.concat(F.lit("/files/"), F.col("_key")))
    cols = [c for c in table.columns if c != url_col]
    base = F.col(url_col) if url_col in table.columns else F.lit(None).cast("string")
    return j.select(*cols, F.coalesce(url, base).alias(url_col))
