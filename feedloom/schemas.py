"""Record shapes, modality registry and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: results depend on these being exactly so -----------------
VOCABULARY = 50257
SEQUENCE_LENGTH = 128
IMAGE_SIDE = 224
PARQUET_SHARD_ROWS = 50_000
TAR_SHARD_ROWS = 5_000
INDEXED_BYTES_PER_SAMPLE = 2048
ROW_CAP = 10_000
SMOKE_BATCHES = 20
BATCH_SIZES = [32, 64, 128]
TEXT_FIELDS = ["text", "txt", "__text__"]
IMAGE_FIELDS = ["jpeg_bytes", "image", "img", "pixel_values", "jpg"]
TAR_IMAGE_FIELDS = ["jpg", "jpeg", "png", "img"]
BUFFER_ROWS = {"text": 1000, "images": 500, "image+text": 1000}
FORMAT_FOLDERS = {"parquet": "parquet", "tar": "webdataset", "indexed": "mds"}
KEY_FORMAT = "%08d"
PARQUET_SHARD_FORMAT = "shard-%05d-of-%05d.parquet"
TAR_SHARD_FORMAT = "shard-%06d.tar"
INDEXED_SHARD_FORMAT = "shard.%05d.mds"
RUN_FORMAT = "%s_%s_bs%d_w%d_epoch%d"
GAUGES = ["gpu_util_pct", "gpu_mem_gb", "cpu_util_pct", "ram_used_gb", "shm_used_gb"]
UTIL_BANDS = [0, 50, 80]
MEMORY_BANDS = [0, 16, 20]
CAPTURE_PHASES = {"wait": 2, "warmup": 1, "active": 5}
# -----------------------------------------------------------------------------

TEXT_SOURCE = T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.StringType())])
IMAGE_STRUCT = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
IMAGE_SOURCE = T.StructType([T.StructField("image", IMAGE_STRUCT), T.StructField("label", T.IntegerType())])
PAIR_SOURCE = T.StructType([T.StructField("jpg", T.BinaryType()), T.StructField("txt", T.StringType())])

MODALITIES = {"text": TEXT_SOURCE, "images": IMAGE_SOURCE, "image+text": PAIR_SOURCE}

INDEXED_COLUMNS = {
    "text": {"__id__": "int", "text": "str", "meta": "str"},
    "images": {"__id__": "int", "image": "bytes", "label": "int"},
    "image+text": {"__id__": "int", "jpg": "bytes", "txt": "str"},
}

TENSOR = T.StructType(
    [
        T.StructField("shape", T.ArrayType(T.IntegerType())),
        T.StructField("dtype", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("shard_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
    ]
)

EPOCH_RECORD = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("batches", T.LongType()),
        T.StructField("total_samples", T.LongType()),
        T.StructField("elapsed_sec", T.DoubleType()),
        T.StructField("samples_per_sec", T.DoubleType()),
        T.StructField("data_stall_pct", T.DoubleType()),
        T.StructField("extract_images_pct", T.DoubleType()),
        T.StructField("gpu_util_pct", T.DoubleType()),
        T.StructField("gpu_mem_gb", T.DoubleType()),
        T.StructField("gpu_util_min", T.DoubleType()),
        T.StructField("cpu_util_pct", T.DoubleType()),
        T.StructField("ram_used_gb", T.DoubleType()),
        T.StructField("shm_used_gb", T.DoubleType()),
        T.StructField("shm_peak_gb", T.DoubleType()),
        T.StructField("loader", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("num_workers", T.IntegerType()),
        T.StructField("gpu_name", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

GAUGE_READING = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.DoubleType()),
    ]
)


def require(value: str, allowed, what: str) -> str:
    """Reject an unknown choice before any job starts."""
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(sorted(allowed))}; got {value!r}")
    return value


def check_run(loader: str, dataset: str, batch_size: int, workers: int = 1) -> None:
    """Reject a run that cannot be built, before any job starts."""
    require(loader, FORMAT_FOLDERS, "loader")
    require(dataset, MODALITIES, "dataset")
    if batch_size < 1 or workers < 1:
        raise ValueError("batch size and workers must be at least 1")


def modality_schema(modality: str) -> T.StructType:
    return MODALITIES[require(modality, MODALITIES, "modality")]
