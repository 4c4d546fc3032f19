"""Files in the shared folder, written and read inside tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pulsegrid.shared import opened  # noqa: F401  (readers take it from here)


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it into place, so that a name never stands for half a file.

    Names hold the attempt that wrote them: of a task that runs twice, each attempt has its own files.
    """
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
