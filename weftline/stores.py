"""Files by name: by the driver on any file system that Spark knows, by tasks in the stores that Arrow reaches."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import SparkSession

from weftline.scratch import hadoop_file


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3 and s3a, gs, abfs), and the path within it."""
    scheme = urlsplit(uri).scheme if "://" in uri or uri.startswith("file:") else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), (unquote(urlsplit(uri).path) if scheme else uri)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + uri[len(scheme) :])


def reachable(uri: str) -> bool:
    """Whether tasks can open files of this store themselves; else only Spark's readers and writers can."""
    try:
        opened(uri)
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def input_file(uri: str):
    """A file that a task reads at any offset."""
    files, path = opened(uri)
    return files.open_input_file(path)


class Upload:
    """A file that a task writes, which appears under its name when it is whole: the task may be lost, or run twice."""

    def __init__(self, uri: str):
        self.files, self.path = opened(uri)
        moves = isinstance(self.files, (fs.LocalFileSystem, fs.HadoopFileSystem))  # other stores show an object when it is closed
        folder, _, name = self.path.rpartition("/")
        self.at = f"{folder}/.{name}.{uuid.uuid4().hex}" if moves else self.path
        if moves and folder:
            self.files.create_dir(folder, recursive=True)
        self.out, self.size = self.files.open_output_stream(self.at), 0

    closed = False  # as a file has it

    def write(self, data) -> int:
        self.out.write(data)
        n = memoryview(data).nbytes
        self.size += n
        return n

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.out.close()
        if self.at != self.path:
            self.files.move(self.at, self.path)


def upload(uri: str, data: bytes) -> None:
    file = Upload(uri)
    file.write(data)
    file.close()


def there(uri: str) -> bool:
    files, path = opened(uri)
    return files.get_file_info(path).type != fs.FileType.NotFound


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark reads it: a bare path is one of the default file system."""
    at, files = hadoop_file(spark, path)
    return str(files.makeQualified(at).toString())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = hadoop_file(spark, path)
    return files.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where there is no such folder."""
    at, files = hadoop_file(spark, folder)
    return sorted(str(x.getPath().getName()) for x in files.listStatus(at)) if files.exists(at) else []


def make_folder(spark: SparkSession, path: str) -> None:
    at, files = hadoop_file(spark, path)
    files.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = hadoop_file(spark, path)
    files.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    at, files = hadoop_file(spark, path)
    if not files.rename(at, hadoop_file(spark, to)[0]):
        raise OSError(f"cannot rename {path} to {to}")


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file; without ``replace`` it is an error if the file is there."""
    at, files = hadoop_file(spark, path)
    out = files.create(at, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None."""
    at, files = hadoop_file(spark, path)
    if not files.exists(at):
        return None
    file = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
    finally:
        file.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole, unless there is one of its name: False then, and that one stays."""
    jvm = spark.sparkContext._jvm
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path), spark.sparkContext._jsc.hadoopConfiguration())
    at = jvm.org.apache.hadoop.fs.Path
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(at(draft), at(path), none)  # without OVERWRITE: fails if the name is taken
        return True
    except Py4JJavaError as e:
        delete(spark, draft)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or exists(spark, path):
            return False
        raise
