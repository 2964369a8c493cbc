"""Text expressions over layer names and media bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed word lists.
ARM_WORDS = r"\b(hand|arm|forearm|upper ?arm|palm|glove|wrist|elbow|shoulder)\b"
LEG_WORDS = r"\b(leg|foot|feet|shoe|shoes|boot|sneaker|thigh|shin|calf|knee|ankle)\b"
TORSO_WORDS = r"\b(torso|body|chest|hips?|pelvis|spine|trunk)\b"
LEFT_WORDS = r"\b(left|lt|lh|ll)\b|^l[\s_-]"
RIGHT_WORDS = r"\b(right|rt|rh|rl)\b|^r[\s_-]"


# Marks that programs put on copied layers (fixed).
COPY_MARKS = ("copy", "copi", "copis", "copie", "copies")


def plain_name(name: Column) -> Column:
    """The words of a layer name in lower case, without copy marks and a number at the end.

    Words are parted by white space, `_`, `-` and `.`, and where a capital follows a small letter. A number
    that is all there is stays.
    """
    cut = F.split(F.coalesce(name, F.lit("")), r"[\s_\-.]+|(?<=[a-z])(?=[A-Z])")
    words = F.filter(F.transform(cut, F.lower), lambda w: (w != "") & ~w.isin(*COPY_MARKS))
    end = F.try_element_at(words, F.lit(-1))
    numbered = end.rlike("^[0-9]+$") & ((F.size(words) > 1) | (F.get(cut, F.lit(0)) != end))
    return F.array_join(F.slice(words, F.lit(1), F.size(words) - F.coalesce(numbered, F.lit(False)).cast("int")), " ")


def limb_role(name: Column) -> Column:
    """Struct (role, skipped): arm or leg with a side, or the reason why a limb-like name is left out."""
    n = plain_name(name)
    part = F.when(n.rlike(ARM_WORDS), "arm").when(n.rlike(LEG_WORDS), "leg")
    side = F.when(n.rlike(LEFT_WORDS), "l").when(n.rlike(RIGHT_WORDS), "r")
    torso = n.rlike(TORSO_WORDS)
    return F.struct(
        F.when(~torso, F.concat(part, F.lit("-"), side)).alias("role"),
        F.when((n != "") & torso, "torso-like name").when((n != "") & part.isNotNull() & side.isNull(), "no left or right").alias("skipped"))


ESCAPE = r"_x[0-9A-Fa-f]{2,6}_"


def decode_escaped_name(name: Column) -> Column:
    """Turn _xHH_ escapes (2 to 6 hex digits) back into characters; impossible code points stay as they are."""
    text = F.split(name, ESCAPE)
    marks = F.regexp_extract_all(name, F.lit(f"({ESCAPE})"), F.lit(1))

    def char(m: Column) -> Column:
        digits = F.regexp_extract(m, r"_x([0-9A-Fa-f]+)_", 1)
        code = F.conv(digits, 16, 10).cast("long")
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(m)

    pieces = F.transform(text, lambda s, i: F.concat(s, F.coalesce(char(F.get(marks, i)), F.lit(""))))
    return F.array_join(pieces, "")


def sniff_media(content: Column) -> Column:
    """Media type from the first bytes; null when it is none of the known ones."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (F.when(head(1, 3) == "FFD8FF", "image/jpeg").when(head(1, 8) == "89504E470D0A1A0A", "image/png")
            .when(head(1, 4) == "47494638", "image/gif").when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "image/webp"))


def decode_data_url(text: Column) -> Column:
    """Bytes of base64 text or of a data: URL; null when it is not valid base64."""
    body = F.trim(text)
    # everything after the first comma is the payload
    payload = F.when(F.instr(body, ",") > 0, F.regexp_replace(body, "^[^,]*,", "")).otherwise("")
    body = F.when(body.startswith("data:"), payload).otherwise(body)
    strict = body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0) & (body != "")
    return F.when(strict, F.try_to_binary(body, F.lit("base64")))


def norm_box(x: Column, y: Column, w: Column, h: Column, view: tuple[Column, Column, Column, Column],
             m: tuple[Column, Column, Column, Column, Column, Column]) -> Column:
    """Box of the four transformed corners, normalized by the view box (x, y, w, h) and clamped; 4 places."""
    a, b, c, d, e, f = m
    pts = [(x, y), (x + w, y), (x, y + h), (x + w, y + h)]
    xs, ys = [a * px + c * py + e for px, py in pts], [b * px + d * py + f for px, py in pts]
    cl = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x0, x1 = (F.least(*xs) - view[0]) / view[2], (F.greatest(*xs) - view[0]) / view[2]
    y0, y1 = (F.least(*ys) - view[1]) / view[3], (F.greatest(*ys) - view[1]) / view[3]
    return F.when((w > 0) & (h > 0), F.array(*[F.round(v, 4) + 0.0 for v in (cl(x0), cl(y0), cl(x1 - x0), cl(y1 - y0))]))
