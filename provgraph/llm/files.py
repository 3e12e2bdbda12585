"""Files that tasks write and read at byte offsets in the shared folder.

Any file system that Arrow opens from a URI will do (``file:``, ``hdfs:``, ``s3:``, ``gs:``). A task
writes under a name of its own attempt and reports the file in a row; the rows, kept as a table,
are the manifest. Files of failed or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=16)
def _opened(scheme_and_host: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(scheme_and_host)[0]


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    if uri.startswith("file:"):
        path = "/" + uri[5:].lstrip("/")
        return _opened("file:///"), path
    scheme, _, rest = uri.partition("://")
    host, slash, path = rest.partition("/")
    system = _opened(f"{scheme}://{host}/")
    return system, (f"/{path}" if scheme in ("hdfs", "viewfs") else f"{host}{slash}{path}")


def create(folder: str, suffix: str) -> tuple[str, object]:
    """(uri, output stream) of a new file in ``folder`` under a name of its own."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_at(uri: str):
    """A file to read at offsets; close it after use."""
    system, path = locate(uri)
    return system.open_input_file(path)
