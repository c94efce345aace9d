"""Files of any store that pyarrow opens, and folders whose files appear together.

A folder is *published* by one small file, ``_manifest.json``, that names the folder's data
files.  Tasks write to a folder of their own write; its files don't belong to the published
folder until the manifest says so, and a reader that knows manifests sees the old files or
the new ones, never a mixture, and never those of a write that broke off.
"""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs as pafs

MANIFEST = "_manifest.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def qualified(spark, path: str) -> str:
    """The path as a URI, by Spark's default store where it names none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf).makeQualified(place).toString()


def reachable(path: str) -> bool:
    """Whether Python can open the store of this URI; Spark's own readers may reach others."""
    try:
        store, place = opened(path)
        return store.get_file_info(place).type != pafs.FileType.NotFound
    except Exception:  # no such store here
        return False


def files_of(path: str) -> list[tuple[str, int]]:
    """Path and bytes of a file, of a published folder's files in their order, or of any folder's by name."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [(place, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = manifest(path)
    if listed is not None:
        return [(f"{place}/{f['name']}", f["bytes"]) for f in listed["files"]]
    found = [f for f in store.get_file_info(pafs.FileSelector(place)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


def manifest(path: str) -> dict | None:
    store, place = opened(path)
    if store.get_file_info(f"{place}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{place}/{MANIFEST}") as f:
        return json.loads(f.read())


class Publication:
    """One write of a folder: tasks call :meth:`create`, the driver :meth:`publish` or :meth:`drop`."""

    def __init__(self, path: str):
        self.path, self.data = path, f"data-{uuid.uuid4().hex}"

    def create(self, name: str):
        store, place = opened(self.path)
        store.create_dir(f"{place}/{self.data}", recursive=True)
        return store.open_output_stream(f"{place}/{self.data}/{name}")

    def publish(self, files: list[dict], append: bool = False, **about) -> None:
        """Replace the manifest, and delete what the old one named (unless its files are kept before the new ones)."""
        store, place = opened(self.path)
        old = manifest(self.path) or {"files": []}
        store.create_dir(place, recursive=True)
        named = [f | {"name": f"{self.data}/{f['name']}"} for f in files]
        waiting = f"{place}/.{self.data}.json"
        with store.open_output_stream(waiting) as f:
            f.write(json.dumps({"files": (old["files"] if append else []) + named, **about}).encode())
        store.move(waiting, f"{place}/{MANIFEST}")
        if not append:
            for folder in {f["name"].split("/")[0] for f in old["files"]}:
                store.delete_dir(f"{place}/{folder}")

    def drop(self) -> None:
        store, place = opened(self.path)
        if store.get_file_info(f"{place}/{self.data}").type == pafs.FileType.Directory:
            store.delete_dir(f"{place}/{self.data}")
