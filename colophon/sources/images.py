"""Pictures: sizes and perceptual hashes on the executors, and JPEG codecs for the few files of a batch.

Decoding is the JVM's (ImageIO), through Spark's image source.  That source leaves out names that begin with _ or ., so a
folder is read through a view of links with other names.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import phash, shrink, to_grey

# The steps in which a file is made smaller, as quality first and then as scale.
QUALITIES, SCALES, SCALED_QUALITY, CALL_QUALITY = [92, 82, 72, 62, 52], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4], 75, 85
SHARPEN_RADIUS, SHARPEN_PERCENT, SHARPEN_THRESHOLD = 1.2, 60, 2


def view(folder: str, names: list[str], work: str) -> str:
    """A folder of links to the named files, each name behind `v-`."""
    os.makedirs(work, exist_ok=True)
    for name in names:
        link = os.path.join(work, f"v-{name}")
        if not os.path.lexists(link):
            os.symlink(os.path.join(os.path.abspath(folder), name), link)
    return work


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """name, width, height, phash (16 hexadecimal digits) of a view's files; nulls where a file can't be decoded."""
    images = spark.read.format("image").option("dropInvalid", False).load(f"file://{os.path.abspath(folder)}")
    rows = images.select(F.substring(F.element_at(F.split("image.origin", "/"), -1), 3, 1 << 30).alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")

    def run(it):
        for batch in it:
            found = []
            for width, height, channels, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "channels", "data")), strict=True):
                found.append(phash(shrink(to_grey(data, width, height, channels), 32)) if width and width > 0 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "width", "height")), pa.array(found, pa.string())], ["name", "width", "height", "phash"])

    # Few rows a batch: a decoded picture is large.
    hashed = rows.mapInArrow(run, "name string, width int, height int, phash string")
    size = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return hashed.select("name", size("width"), size("height"), "phash")


def normalise(content: bytes, name: str, limit: int, encode: Callable[..., bytes]) -> bytes | None:
    """A JPEG file of at most `limit` bytes, if the steps reach that; None where the file can stay as it is.

    PNG files and files above the limit are encoded again: with less quality first, then from the original pixels at
    smaller scales, sharpened.  encode(content, scale=, quality=, sharpen=) gives JPEG bytes.
    """
    if not name.lower().endswith(".png") and len(content) <= limit:
        return None
    out = b""
    for quality in QUALITIES:
        out = encode(content, scale=1.0, quality=quality, sharpen=False)
        if len(out) <= limit:
            return out
    for scale in SCALES:
        out = encode(content, scale=scale, quality=SCALED_QUALITY, sharpen=True)
        if len(out) <= limit:
            break
    return out


class JvmCodec:
    """JPEG encoding by the driver's JVM, for the files of one batch."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway

    def _read(self, content: bytes):
        image = self.jvm.javax.imageio.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(content))
        if image is None:
            raise ValueError("not a picture")
        return image

    def _drawn(self, image, width: int, height: int):
        """RGB pixels at a size; halved step by step first, so that no pixel is passed over."""
        awt = self.jvm.java.awt
        w, h = image.getWidth(), image.getHeight()
        while w > 0:
            w, h = max(width, w // 2), max(height, h // 2)
            out = awt.image.BufferedImage(w, h, awt.image.BufferedImage.TYPE_INT_RGB)
            pen = out.createGraphics()
            pen.setRenderingHint(awt.RenderingHints.KEY_INTERPOLATION, awt.RenderingHints.VALUE_INTERPOLATION_BICUBIC)
            pen.drawImage(image, 0, 0, w, h, None)
            pen.dispose()
            image = out
            if (w, h) == (width, height):
                return out
        return image

    def _sharpened(self, image):
        awt = self.jvm.java.awt
        more = SHARPEN_PERCENT / 100
        kernel = self.gateway.new_array(self.jvm.float, 9)
        for i, x in enumerate([1, 2, 1, 2, 4, 2, 1, 2, 1]):  # a blur of about one pixel, taken off
            kernel[i] = float((1 + more if i == 4 else 0) - more * x / 16)
        return awt.image.ConvolveOp(awt.image.Kernel(3, 3, kernel), awt.image.ConvolveOp.EDGE_NO_OP, None).filter(image, None)

    def _written(self, image, quality: int) -> bytes:
        io = self.jvm.javax.imageio
        writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
        options = writer.getDefaultWriteParam()
        options.setCompressionMode(io.ImageWriteParam.MODE_EXPLICIT)
        options.setCompressionQuality(quality / 100)
        out = self.jvm.java.io.ByteArrayOutputStream()
        sink = io.ImageIO.createImageOutputStream(out)
        writer.setOutput(sink)
        writer.write(None, io.IIOImage(image, None, None), options)
        sink.close()
        writer.dispose()
        return bytes(out.toByteArray())

    def encode(self, content: bytes, scale: float = 1.0, quality: int = QUALITIES[0], sharpen: bool = False) -> bytes:
        image = self._read(content)
        drawn = self._drawn(image, max(1, int(image.getWidth() * scale)), max(1, int(image.getHeight() * scale)))
        return self._written(self._sharpened(drawn) if sharpen else drawn, quality)

    def fit(self, content: bytes, side: int = 1024) -> bytes:
        """A JPEG file that fits a square of that side; smaller pictures keep their size."""
        image = self._read(content)
        w, h = image.getWidth(), image.getHeight()
        scale = min(1.0, side / max(w, h))
        return self._written(self._drawn(image, max(1, round(w * scale)), max(1, round(h * scale))), CALL_QUALITY)
