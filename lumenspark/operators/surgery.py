"""Edits of segments in gain map files, a row per file; a file that cannot be edited gives a null and the reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..codecs import container as c
from ..sources.files import mapped

EDITED = "path string, content binary, problem string"


def edited(files: DataFrame, edit: Callable[..., bytes], more: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, problem): files(path, content, more) after an edit of their bytes."""

    def run(path, content, *rest) -> Iterator[tuple]:
        try:
            yield path, edit(bytes(content or b""), *rest), None
        except (c.FormatError, IndexError) as e:
            yield path, None, str(e)

    return mapped(files.select("path", "content", *more), run, EDITED)


def insert_segment(files: DataFrame, segment: str = "segment") -> DataFrame:
    """A segment put behind the base marker of each primary, or behind its index; the index is made to fit."""
    anchors = [(0xE2, c.URN[:-1]), (0xE2, c.MPF_ID)]
    return edited(files, lambda data, made: _primary(data, lambda p: c.insert_after(p, anchors, bytes(made))), (segment,))


def drop_segment(files: DataFrame, image: int, marker: int, prefix: bytes) -> DataFrame:
    """The first segment of a kind taken out of the primary (0) or a later image; the index is made to fit."""

    def edit(data: bytes) -> bytes:
        images = c.split(data)
        images[image] = c.drop_segment(images[image], marker, prefix)
        return c.recompute_index(b"".join(images))

    return edited(files, edit)


def _primary(data: bytes, edit: Callable[[bytes], bytes]) -> bytes:
    first, *rest = c.split(data)
    return c.recompute_index(edit(first) + b"".join(rest))


def spliced(pairs: DataFrame) -> DataFrame:
    """Primary of pairs(path, content, trailer) with the trailer of the other file; sizes and index are made to fit."""
    return edited(pairs, lambda a, b: c.recompute_index(c.splice(a, bytes(b))), ("trailer",))


def three_images(pairs: DataFrame, packet: str = "packet") -> DataFrame:
    """Files of primary, own gain map and the gain map of `trailer`, which gets an XMP packet; the index is rebuilt for three images."""

    def edit(data: bytes, other: bytes, xml: str) -> bytes:
        first, gain = c.split(data)[:2]
        return c.with_index_of(first, [gain, c.replace_xmp(c.split(bytes(other))[1], xml)])

    return edited(pairs, edit, ("trailer", packet))


def recomputed(files: DataFrame) -> DataFrame:
    """Indexes made to fit the images that are in the files."""
    return edited(files, c.recompute_index)


def retyped(files: DataFrame) -> DataFrame:
    """Indexes whose entries state what their images are."""
    return edited(files, c.retype_index)
