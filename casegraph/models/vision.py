"""Pages read by a vision model: pictures to PNG, rotation told and mended, text."""

from __future__ import annotations

import base64
import io
import re
from collections.abc import Callable
from dataclasses import dataclass

LABELS = ("NONE", "ROTATE_90", "ROTATE_180", "ROTATE_270")
READ_PROMPT = (
    "Write down all text of this picture word for word, in reading order, as markdown. Mark boxes that are ticked as [X] and empty ones as [ ], "
    "a signature as [Signature] and a stamp as [Stamp]. Copy numbers with every digit and mark. Add nothing of your own."
)
ROTATION_PROMPT = "By how much is the text of this picture turned clockwise from upright? Answer with one of these labels and nothing else: NONE, ROTATE_90, ROTATE_180, ROTATE_270."


@dataclass(frozen=True)
class Reading:
    """How documents are read: dots an inch, least text of a page that needs no model, tokens of a reply, and prompts."""

    dpi: int = 300
    min_text: int = 60
    use_text_layer: bool = True
    max_tokens: int = 2500
    temperature: float = 0.0
    mend_rotation: bool = False
    prompt: str = READ_PROMPT
    rotation_prompt: str = ROTATION_PROMPT


def see(client: Callable[..., str], png: bytes, prompt: str, max_tokens: int, temperature: float = 0.0) -> str:
    """The reply about a picture; the model isn't to think aloud."""
    picture = {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{base64.b64encode(png).decode()}"}}
    message = {"role": "user", "content": [{"type": "text", "text": prompt}, picture]}
    return client([message], max_tokens, temperature, {"chat_template_kwargs": {"enable_thinking": False}})


def rotation_of(reply: str) -> str:
    """Label of a reply: it alone, or the one it holds; NONE where it can't be told."""
    bare = re.sub("[^A-Z0-9_]", "", reply.upper())
    return bare if bare in LABELS else next((x for x in LABELS if x in bare), "NONE")


def _picture(content: bytes):
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("pictures other than PNG, and turning them, need the package Pillow") from e
    return Image.open(io.BytesIO(content))


def to_png(picture) -> bytes:
    out = io.BytesIO()
    picture.save(out, format="PNG")
    return out.getvalue()


def turned(picture, label: str):
    """A picture turned back to upright; the page grows with a quarter turn."""
    back = {"ROTATE_90": 90, "ROTATE_180": 180, "ROTATE_270": 270}.get(label)
    return picture if back is None else picture.rotate(back, expand=back != 180)


def read_picture(client: Callable[..., str], content: bytes, is_png: bool, how: Reading) -> tuple[str, str]:
    """Text and rotation label of a picture."""
    png, label = content if is_png else to_png(_picture(content)), "NONE"
    if how.mend_rotation:
        label = rotation_of(see(client, png, how.rotation_prompt, 16, how.temperature))
        if label != "NONE":
            png = to_png(turned(_picture(png), label))
    return see(client, png, how.prompt, how.max_tokens, how.temperature), label
