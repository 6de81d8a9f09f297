"""Self-contained HTML: addresses of images, scripts and style sheets become data addresses; what is not found stays."""

from __future__ import annotations

import base64
import html
import re
from collections.abc import Callable

Resolve = Callable[[str], tuple[bytes, str] | None]

TAG = re.compile(r"<(img|script|link|source|audio|video|embed|input|iframe|style)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
CSS_URL = re.compile(r"url\(\s*(\"[^\"]*\"|'[^']*'|[^)\"'\s]*)\s*\)|@import\s+(\"[^\"]*\"|'[^']*')")


def data_uri(data: bytes, mime: str) -> str:
    return f"data:{mime or 'application/octet-stream'};base64,{base64.b64encode(data).decode()}"


def join(base: str, url: str) -> str:
    """A relative address beside the file that names it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|/|#", url) or "/" not in base:
        return url
    return base.rsplit("/", 1)[0] + "/" + url


def inline_css(css: str, base: str, resolve: Resolve, depth: int = 8) -> str:
    """The addresses in a style sheet inlined; imported sheets are inlined in turn."""

    def put(m: re.Match) -> str:
        url = (m[1] or m[2] or "").strip("\"'")
        if not url or url.startswith(("data:", "#")) or not depth:
            return m[0]
        at = join(base, url)
        found = resolve(at)
        if found is None:
            return m[0]
        data, mime = found
        if mime == "text/css":
            data = inline_css(data.decode("utf-8", "replace"), at, resolve, depth - 1).encode()
        return ("@import " if m[2] else "") + f"url({data_uri(data, mime)})"

    return CSS_URL.sub(put, css)


def inline_resources(page: str, resolve: Resolve) -> str:
    """The page with src, style-sheet href and CSS addresses replaced where resolve finds them."""
    out, at = [], 0
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        out.append(page[at : m.start()])
        at = m.end()
        tag, attrs = m[1].lower(), m[2]

        def swap(a: re.Match, tag=tag) -> str:
            name, url = a[1].lower(), html.unescape(a[2].strip("\"'"))
            if name == "href" and tag != "link" or url.startswith(("data:", "#")):
                return a[0]
            found = resolve(url)
            if found is None:
                return a[0]
            data, mime = found
            if mime == "text/css":
                data = inline_css(data.decode("utf-8", "replace"), url, resolve).encode()
            return f'{a[1]}="{data_uri(data, mime)}"'

        out.append(f"<{m[1]}{re.sub(r'(?i)(?<![-\w])(src|href|poster)\s*=\s*(\"[^\"]*\"|\'[^\']*\'|[^\s>\"\']+)', swap, attrs)}>")
        if tag == "style":
            end = page.lower().find("</style", at)
            end = len(page) if end < 0 else end
            out.append(inline_css(page[at:end], "", resolve))
            at = end
    return "".join([*out, page[at:]])
