"""Image work that needs packages which are not here: the interfaces, each with a clear error, and the order of its steps."""

from __future__ import annotations

from collections.abc import Callable

#: Formats and names of the steps before text recognition.
IMAGE_FORMATS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
STEPS = ("grayscale", "resize", "denoise", "bilateral", "clahe", "deskew", "threshold", "sharpen", "invert")
STRATEGIES = ("blackout", "pixelate", "blur")
NEEDS = {".pdf": "PDF redaction needs PyMuPDF, which is not installed", "image": "Image redaction needs Pillow, which is not installed", "load": "Reading images needs OpenCV, which is not installed", "ocr": "Text recognition needs PaddleOCR, which is not installed"}


class MissingPackage(RuntimeError):
    """The work needs a package that is not installed."""


def load_image(content: bytes):
    """Pixels of an image file."""
    try:
        import cv2
        import numpy as np
    except ImportError as e:
        raise MissingPackage(NEEDS["load"]) from e
    pixels = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)
    if pixels is None:
        raise ValueError("Failed to load the image")
    return pixels


def preprocess(pixels, steps: tuple[str, ...], known: dict[str, Callable]) -> tuple[object, list[str]]:
    """Applies steps in order; returns the pixels and warnings about steps that are not known. ``known`` holds the steps that are installed."""
    warnings = []
    for name in steps:
        if name not in STEPS:
            warnings.append(f"Unknown preprocessing step: {name}")
        elif name not in known:
            raise MissingPackage(f"The step {name} needs OpenCV, which is not installed")
        else:
            pixels = known[name](pixels)
    return pixels, warnings


def recognise(pixels, language: str = "en"):
    """Lines of text with scores and corners of their boxes."""
    try:
        from paddleocr import PaddleOCR
    except ImportError as e:
        raise MissingPackage(NEEDS["ocr"]) from e
    return PaddleOCR(lang=language).ocr(pixels)


def redact_image(content: bytes, boxes: list[list[int]], strategy: str = "blackout") -> bytes:
    """An image with its boxes blacked out, in coarse pixels or blurred, as PNG."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    try:
        from PIL import Image, ImageDraw, ImageFilter
    except ImportError as e:
        raise MissingPackage(NEEDS["image"]) from e
    import io

    image = Image.open(io.BytesIO(content)).convert("RGB")
    for box in boxes:
        if strategy == "blackout":
            ImageDraw.Draw(image).rectangle(box, fill="black")
            continue
        part = image.crop(box)
        small = part.resize((max(1, part.width // 8), max(1, part.height // 8)))
        image.paste(small.resize(part.size, Image.NEAREST) if strategy == "pixelate" else part.filter(ImageFilter.GaussianBlur(10)), box)
    out = io.BytesIO()
    image.save(out, "PNG")
    return out.getvalue()


def redact_pdf(content: bytes, values: list[str]) -> bytes:
    """A PDF with all places of the values filled black."""
    try:
        import fitz
    except ImportError as e:
        raise MissingPackage(NEEDS[".pdf"]) from e
    with fitz.open(stream=content, filetype="pdf") as pages:
        for page in pages:
            for value in values:
                for place in page.search_for(value) or page.search_for(" ".join(value.split())):
                    page.add_redact_annot(place, fill=(0, 0, 0))
            page.apply_redactions()
        return pages.tobytes()
