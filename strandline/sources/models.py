"""Model files: a catalogue of what the external operators use, and their cache."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from strandline.errors import EngineError

#: The models by role, and their size in MB, about.
CATALOGUE = (
    ("asr_accurate", "onnx-community/whisper-large-v3-turbo", "asr", 2750),
    ("asr_fast", "Xenova/whisper-base", "asr", 280),
    ("vad", "onnx-community/silero-vad", "vad", 2),
    ("segmentation", "onnx-community/pyannote-segmentation-3.0", "segmentation", 6),
    ("speaker", "onnx-community/wespeaker-voxceleb-resnet34-LM", "speaker", 26),
    ("text_embedding", "Xenova/multilingual-e5-small", "embedding", 465),
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "name string, model string, role string, approx_mb int")


def cached_path(root: str, address: str) -> str:
    """Where a file of an address is kept: model and file name for addresses of a model hub, host and path for others.

    Parts that climb out of the folder are left out.
    """
    hub = re.fullmatch(r"https?://[^/]+/(.+?)/resolve/[^/]+/(.+)", address)
    kept = f"{hub[1]}/{hub[2]}" if hub else re.sub(r"\A[a-z]+://", "", address)
    return os.path.join(root, *[p for p in kept.split("/") if p not in ("", ".", "..")])


def ensure_file(address: str, path: str, fetch: Callable[[str], Iterator[bytes]], offline: bool = False) -> str:
    """The file at ``path``, fetched if it isn't there; it appears whole or not at all."""
    if os.path.isfile(path) and os.path.getsize(path):
        return path
    if offline:
        raise EngineError("OFFLINE", f"{os.path.basename(path)} is not in the cache, and nothing is fetched offline", "fetch the models while there is a network")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        size = 0
        with open(part, "wb") as f:
            for chunk in fetch(address):
                size += len(chunk)
                f.write(chunk)
        if not size:
            raise EngineError("MODEL_LOAD_FAILED", f"nothing came from {address}")
        os.replace(part, path)
    except OSError as e:
        raise EngineError("MODEL_LOAD_FAILED", f"could not fetch {address}: {e}") from e
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def is_cached(root: str, model: str) -> bool:
    """Whether anything of a model is in the cache."""
    return any(files for _, _, files in os.walk(os.path.join(root, *model.split("/"))))
