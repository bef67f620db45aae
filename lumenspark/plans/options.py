"""Options of an encode: names, defaults, ranges, and the strict parsing of an argument list."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import color, tone

# Spellings that the option interface accepts, and the names it reports.
CHANNELS = {"mono": False, "Monochrome": False, "1": False, "rgb": True, "RGB": True, "3": True}
PEAKS = {"softened": "softened", "soft": "softened", "exact": "exact", "peak": "exact"}


class OptionError(ValueError):
    """An argument that is unknown, lacks its value, or lies outside its range."""


def integer(text: str, name: str) -> int:
    try:
        return int(text.lstrip(), 10) if "_" not in text and text == text.rstrip() else int("x")
    except ValueError:
        raise OptionError(f"invalid integer for {name}: {text}") from None


def number(text: str, name: str) -> float:
    try:
        return float(text.lstrip()) if "_" not in text and text == text.rstrip() else float("x")
    except ValueError:
        raise OptionError(f"invalid number for {name}: {text}") from None


def parse_peak(name: str) -> str:
    if name not in PEAKS:
        raise ValueError(f"unknown peak detection {name!r}")
    return PEAKS[name]


@dataclass
class EncodeOptions:
    """Everything that decides how an image is encoded."""

    input: str = ""
    output: str = ""
    headroom: float = 4.0
    color_space: str = "p3"
    subsample: int = 1
    rgb: bool = True
    highlight_knee: float = 0.80
    apple: bool = False
    quality: int = 90
    gainmap_quality: int = 85
    gamma: float = 1.0
    offset_sdr: float = 1 / 64
    offset_hdr: float = 1 / 64
    tone_map: str = "local"
    peak_detect: str = "softened"
    shape: str = "auto"
    sdr_lift: float = 0.43
    sdr_contrast: float = 1.14
    sdr_detail: float = 1.25
    sdr_knee: float = 0.0
    sdr_edge: float = 4.0
    auto_max_boost: bool = True
    input_primaries: str = "auto"
    input_transfer: str = "auto"
    diffuse_white: float = 203.0
    icc: bool = True
    exif: bool = True
    xmp: bool = True
    optimise: bool = True
    chroma_subsample: bool = False
    threads: int = 0
    json: bool = False
    verbose: bool = False
    handled: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def multi(self) -> bool:
        """Whether the gain map has three channels; the vendor's description allows one only."""
        return self.rgb and not self.apple

    def check(self) -> EncodeOptions:
        """Ranges that hold however the options were made."""
        rules = (
            (1 <= self.quality <= 100, "quality must be between 1 and 100"),
            (1 <= self.gainmap_quality <= 100, "gain map quality must be between 1 and 100"),
            (0 < self.headroom <= 10, "headroom must be above 0 and at most 10"),
            (self.subsample in (1, 2, 4), "subsample must be 1, 2 or 4"),
            (self.gamma > 0, "gamma must be positive"),
            (0 < self.highlight_knee <= 1, "highlight knee must be above 0 and at most 1"),
            (0 <= self.sdr_lift <= 3, "lift must be between 0 and 3"),
            (0.5 <= self.sdr_contrast <= 2, "contrast must be between 0.5 and 2"),
            (0 <= self.sdr_detail <= 2, "detail must be between 0 and 2"),
            (-6 <= self.sdr_knee <= 0, "knee must be between -6 and 0"),
            (self.sdr_edge > 0, "edge must be positive"),
            (self.threads >= 0, "threads must not be negative"),
            (self.color_space in color.PRIMARIES and self.color_space != "prophoto", "not a base colour space"),
        )
        for ok, reason in rules:
            if not ok:
                raise OptionError(reason)
        return self


def _space(text: str) -> str:
    found = color.parse_primaries(text)
    if found in ("auto", "prophoto"):
        raise ValueError("not a base colour space")
    return found


def _channels(text: str) -> bool:
    if text not in CHANNELS:
        raise ValueError("use mono or rgb")
    return CHANNELS[text]


#: Flags with a value: (field, how the text is read).
VALUES = {
    "--input": ("input", None), "-i": ("input", None), "--output": ("output", None), "-o": ("output", None), "--headroom": ("headroom", number),
    "--color-space": ("color_space", _space), "--colour-space": ("color_space", _space), "--subsample": ("subsample", integer), "--channels": ("rgb", _channels),
    "--highlight-knee": ("highlight_knee", number), "--quality": ("quality", integer), "-q": ("quality", integer), "--gainmap-quality": ("gainmap_quality", integer),
    "--gamma": ("gamma", number), "--offset-sdr": ("offset_sdr", number), "--offset-hdr": ("offset_hdr", number), "--tone-map": ("tone_map", tone.parse_curve),
    "--peak-detect": ("peak_detect", parse_peak), "--sdr-lift": ("sdr_lift", number), "--sdr-contrast": ("sdr_contrast", number), "--sdr-detail": ("sdr_detail", number),
    "--sdr-knee": ("sdr_knee", number), "--sdr-edge": ("sdr_edge", number), "--input-primaries": ("input_primaries", color.parse_primaries),
    "--input-transfer": ("input_transfer", color.parse_transfer), "--pq-diffuse-white": ("diffuse_white", number), "--threads": ("threads", integer),
}
#: Flags without one: (field, the value they set).
SWITCHES = {
    "--apple-compatible": ("apple", True), "--no-auto-max-boost": ("auto_max_boost", False), "--no-icc": ("icc", False), "--no-exif": ("exif", False), "--no-xmp": ("xmp", False),
    "--no-optimize": ("optimise", False), "--no-chroma-subsample": ("chroma_subsample", False), "--chroma-subsample": ("chroma_subsample", True), "--json": ("json", True), "--verbose": ("verbose", True),
}


def parse(arguments: list[str]) -> EncodeOptions:
    """Options of an argument list; OptionError says what is wrong. --help and --version end the parsing and set `handled`."""
    o, solve, left = EncodeOptions(), False, iter(arguments)
    for a in left:
        if a in ("--help", "-h", "--version"):
            o.handled = "version" if a == "--version" else "help"
            return o
        if a == "--auto-shape":
            solve = True
        elif a in SWITCHES:
            setattr(o, *SWITCHES[a])
        elif a in VALUES:
            name, read = VALUES[a]
            text = next(left, None)
            if text is None:
                raise OptionError(f"missing value for {a}")
            if read in (integer, number):
                value = read(text, a)
            else:
                try:
                    value = read(text) if read else text
                except ValueError as e:
                    raise OptionError(f"unknown {a}: {text} ({e})") from None
            setattr(o, name, value)
            if name in ("sdr_lift", "sdr_contrast"):
                o.shape = "manual"
        else:
            raise OptionError(f"unknown argument: {a}")
    if solve:
        o.shape = "auto"
    if not o.input or not o.output:
        raise OptionError("missing --input" if not o.input else "missing --output")
    return o.check()
