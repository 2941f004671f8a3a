"""Files that tasks write to, and read from, a folder all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file:, hdfs:, s3:, gs:, ...)."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write ``parts`` (bytes) to ``uri`` so that it appears whole or not at
    all; a repeated task replaces it by the same bytes.  Returns the size."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with fs.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(draft, path)
    return size
