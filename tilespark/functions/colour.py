"""Named colour specifications and channel arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, and code points (primaries, transfer) of the JPEG XL specification.
SPECS = {
    "srgb": (1, 13),
    "srgb-linear": (1, 8),
    "linear-srgb": (1, 8),
    "linear": (1, 8),
    "display-p3": (11, 13),
    "p3": (11, 13),
    "p3-linear": (11, 8),
    "rec709": (1, 1),
    "bt709": (1, 1),
    "rec2020-pq": (9, 16),
    "bt2020-pq": (9, 16),
    "rec2020-hlg": (9, 18),
    "bt2020-hlg": (9, 18),
    "rec2020-linear": (9, 8),
    "bt2020-linear": (9, 8),
}


@dataclass(frozen=True)
class Colour:
    primaries: int = 1
    transfer: int = 13
    white_point: int = 1
    rendering_intent: int = 1
    gamma: float = 0.0

    @property
    def is_hdr(self) -> bool:
        """Perceptual quantiser or hybrid log-gamma."""
        return self.transfer in (16, 18)


def parse_color(spec) -> Colour | None:
    """A specification by name; ``_`` counts as ``-``, case does not count, None stays."""
    if spec is None or isinstance(spec, Colour):
        return spec
    if not isinstance(spec, str):
        raise TypeError("a colour is a name")
    key = spec.strip().lower().replace("_", "-")
    if key not in SPECS:
        raise ValueError(f"unknown colour {spec!r}")
    return Colour(*SPECS[key])


def rgbe_value(mantissa: Column, exponent: Column) -> Column:
    """A shared-exponent component; exponent 0 is black."""
    return F.when(exponent == 0, F.lit(0.0)).otherwise(mantissa * F.pow(F.lit(2.0), exponent - 136))


def scaled(raw: Column, bscale: float, bzero: float) -> Column:
    """FITS scaling."""
    return raw.cast("double") * F.lit(float(bscale)) + F.lit(float(bzero))


def reverse_channels(channels: Column, alpha: bool = False) -> Column:
    """BGR to RGB; the last channel stays if it is alpha."""
    if not alpha:
        return F.reverse(channels)
    n = F.size(channels)
    return F.concat(F.reverse(F.slice(channels, F.lit(1), n - 1)), F.slice(channels, n, F.lit(1)))
