"""Direct downloads: redirects checked one by one, sizes capped while bytes arrive, files that appear whole.

What opens an address is a function, so that nothing here needs a network: it returns the status, the
headers (lower case) and the body as chunks, and follows no redirect itself.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from strandline.errors import EngineError
from strandline.functions.addresses import is_private

#: What a content type says of the extension, the first that fits.
EXTENSIONS = (("mp4", ".mp4"), ("webm", ".webm"), ("mpeg", ".mp3"), ("wav", ".wav"), ("png", ".png"), ("jpeg", ".jpg"))


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: Iterator[bytes]


Open = Callable[[str], Response]
Resolve = Callable[[str], list[str]]


def extension(content_type: str, address: str) -> str:
    for part, ext in EXTENSIONS:
        if part in content_type.lower():
            return ext
    return os.path.splitext(urlsplit(address).path)[1] or ".bin"


def check_host(address: str, resolve: Resolve) -> None:
    """Refuses other schemes than the web's, local names, and names with any private address."""
    parts = urlsplit(address)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https"):
        raise EngineError("DOWNLOAD_FAILED", f"{parts.scheme} is no scheme to fetch from")
    if not host or host == "localhost" or re.search(r"\.(localhost|local|internal|home\.arpa)\Z", host):
        raise EngineError("SOURCE_BLOCKED", f"{host or 'no host'} is a local name")
    try:
        found = [str(ipaddress.ip_address(host))]
    except ValueError:
        found = resolve(host)
    if not found or any(is_private(a) for a in found):
        raise EngineError("SOURCE_BLOCKED", f"{host} has a private address, or none")


def follow(address: str, opened: Open, resolve: Resolve, most: int = 5, allow_private: bool = False) -> tuple[str, Response]:
    """The response behind at most so many redirects; every hop's host is checked."""
    for hop in range(most + 1):
        if not allow_private:
            check_host(address, resolve)
        elif urlsplit(address).scheme not in ("http", "https"):
            raise EngineError("DOWNLOAD_FAILED", "only web addresses are fetched")
        got = opened(address)
        target = got.headers.get("location")
        if not 300 <= got.status < 400 or not target:
            return address, got
        address = urljoin(address, target)
    raise EngineError("DOWNLOAD_FAILED", f"more than {most} redirects")


def download(address: str, root: str, opened: Open, resolve: Resolve, most_bytes: int, most_redirects: int = 5, allow_private: bool = False) -> str:
    """The path of the file behind an address, in a folder of its own; a finished one is used again."""
    folder = os.path.join(root, hashlib.sha1(address.encode()).hexdigest()[:24])
    if not allow_private:
        check_host(address, resolve)
    os.makedirs(folder, exist_ok=True)
    if done := sorted(n for n in os.listdir(folder) if re.fullmatch(r"media\.[A-Za-z0-9]+", n)):
        return os.path.join(folder, done[0])
    last, got = follow(address, opened, resolve, most_redirects, allow_private)
    if not 200 <= got.status < 300:
        raise EngineError("DOWNLOAD_FAILED", f"status {got.status}")
    if int(got.headers.get("content-length") or 0) > most_bytes:
        raise EngineError("SOURCE_TOO_LARGE", f"the file has more than {most_bytes} bytes")
    path = os.path.join(folder, "media" + extension(got.headers.get("content-type", ""), last))
    part, size = path + ".part", 0
    try:
        with open(part, "wb") as f:
            for chunk in got.body:
                size += len(chunk)
                if size > most_bytes:
                    raise EngineError("SOURCE_TOO_LARGE", f"more than {most_bytes} bytes came")
                f.write(chunk)
        os.replace(part, path)
    except OSError as e:
        raise EngineError("DOWNLOAD_FAILED", str(e)) from e
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path
