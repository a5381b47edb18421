"""The hierarchically tiled parquet layout on any file system Spark reaches.

All file access goes through Hadoop's FileSystem, so local and remote paths
work alike.
"""

from __future__ import annotations

# Fixed values of the on-disk format.
PROPERTIES = ("hats.properties", "properties")
COLLECTION = "collection.properties"
PARTITION_INFO = "partition_info.csv"
PARTITION_COLUMNS = ("Norder", "Dir", "Npix")


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def read_text(spark, path: str) -> str:
    fs, p, _ = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_bytes(spark, path: str, data: bytes) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete(spark, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def rename(spark, a: str, b: str) -> None:
    fs, p, path = _fs(spark, a)
    target = path(b)
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(p, target):
        raise OSError(f"cannot move {a} to {b}")


def listing(spark, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []


def parse_properties(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip()
    return out


def format_properties(values: dict) -> bytes:
    return ("#catalog metadata\n" + "".join(f"{k}={'' if v is None else v}\n" for k, v in values.items())).encode()


def pixel_file(order: int, pixel: int, suffix: str = ".parquet") -> str:
    return f"Norder={order}/Dir={pixel // 10000 * 10000}/Npix={pixel}{suffix}"
