"""Dimension tables as row literals: kernels, structuring elements, colour matrices, illuminants, palettes.

The numbers below are fixed values: results depend on exactly these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (rows of weights, normaliser)
KERNELS: dict[str, tuple[list[list[int]], int]] = {
    "sharp_3": ([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]], 1),
    "sharp_5": ([[-1, -1, -1, -1, -1], [-1, 2, 2, 2, -1], [-1, 2, 8, 2, 1], [-1, 2, 2, 2, -1], [-1, -1, -1, -1, -1]], 8),
    "blur_3": ([[0, 1, 0], [1, 1, 1], [0, 1, 1]], 6),
    "blur_5": ([[0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [1, 1, 1, 1, 1], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0]], 13),
    "sharpen_3": ([[0, -2, 0], [-2, 11, -2], [0, -2, 0]], 3),
    "intense_sharpen_3": ([[1, 1, 1], [1, -7, 1], [1, 1, 1]], 1),
    "edge": ([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]], 1),
    "edge_45": ([[-1, 0, 0, 0, 0], [0, -2, 0, 0, 0], [0, 0, 6, 0, 0], [0, 0, 0, -2, 0], [0, 0, 0, 0, -1]], 1),
    "edge_horizontal": ([[0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [-1, -1, 4, -1, -1], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]], 1),
    "edge_vertical": ([[0, 0, -1, 0, 0], [0, 0, -1, 0, 0], [0, 0, 4, 0, 0], [0, 0, -1, 0, 0], [0, 0, -1, 0, 0]], 1),
    "emboss": ([[2, 0, 0], [0, -1, 0], [0, 0, -1]], 1),
    "intense_emboss": ([[-1, -1, -1, -1, 0], [-1, -1, -1, 0, 1], [-1, -1, 0, 1, 1], [-1, 0, 1, 1, 1], [0, 1, 1, 1, 1]], 1),
    "soften_3": ([[1, 1, 1], [1, 1, 1], [1, 1, 1]], 8),
    "soften_5": ([[1, 1, 1, 1, 1]] * 5, 24),
    "gaussian_3": ([[1, 2, 1], [2, 4, 2], [1, 2, 1]], 16),
    "gaussian_5": ([[2, 4, 5, 4, 2], [4, 9, 12, 9, 4], [5, 12, 15, 12, 5], [4, 9, 12, 9, 4], [2, 4, 5, 4, 2]], 159),
    "laplacian_3": ([[0, -1, 0], [-1, 4, -1], [0, -1, 0]], 1),
    "laplacian_5": ([[0, 0, -1, 0, 0], [0, -1, -2, -1, 0], [-1, -2, 16, -2, -1], [0, -1, -2, -1, 0], [0, 0, -1, 0, 0]], 1),
    "motion_9": ([[int(x in (y, 8 - y)) for x in range(9)] for y in range(9)], 18),
    "motion_right_9": ([[int(x == y) for x in range(9)] for y in range(9)], 9),
    "motion_left_9": ([[int(x == 8 - y) for x in range(9)] for y in range(9)], 9),
    "high_pass": ([[-1, -2, -1], [-2, 12, -2], [-1, -2, -1]], 1),
}
#: Masks that no short rule gives, one string for each row.
MASKS: dict[tuple[str, int], list[str]] = {
    ("disk", 3): ["010", "111", "010"],
    ("disk", 5): ["01110", "11111", "11111", "11111", "01110"],
    ("disk", 7): ["0011100", "0111110", "1111111", "1111111", "1111111", "0111110", "0011100"],
    ("disk", 9): ["000111000", "001111100", "011111110", "111111111", "111111111", "111111111", "011111110", "001111100", "000111000"],
    ("ring", 3): ["010", "101", "010"],
    ("ring", 5): ["01110", "10001", "10001", "10001", "01110"],
    ("ring", 7): ["0011100", "0111110", "1110111", "1100011", "1110111", "0111110", "0011100"],
    ("ring", 9): ["000111000", "001111100", "011101110", "111000111", "110000011", "111000111", "011101110", "001111100", "000111000"],
    ("frame", 3): ["111", "101", "111"],
    ("frame", 5): ["11111", "10001", "10001", "10001", "11111"],
    ("frame", 7): ["1111111", "1111111", "1100011", "1100011", "1100011", "1111111", "1111111"],
    ("frame", 9): ["111111111", "111111111", "110000011", "110000011", "110000011", "110000011", "110000011", "111111111", "111111111"],
}
RGB_TO_YUV: dict[str, list[float]] = {
    "bt601": [0.299, 0.587, 0.114, -0.168736, -0.331264, 0.5, 0.5, -0.418688, -0.081312],
    "bt709": [0.2126, 0.7152, 0.0722, -0.11457, -0.38543, 0.5, 0.5, -0.45415, -0.04585],
    "bt2020": [0.2627, 0.678, 0.0593, -0.13963, -0.36037, 0.5, 0.5, -0.45979, -0.04021],
    "smpte240": [0.2122, 0.7013, 0.0865, -0.1162, -0.3838, 0.5, 0.5, -0.4451, -0.0549],
}
YUV_TO_RGB: dict[str, list[float]] = {
    "bt601": [1.0, 0.0, 1.4075, 1.0, -0.34414, -0.7169, 1.0, 1.779, 0.0],
    "bt709": [1.0, 0.0, 1.5748021, 1.0, -0.18732698, -0.468124, 1.0, 1.85559927, 0.0],
    "bt2020": [1.0, 0.0, 1.4745964, 1.0, -0.1645481, -0.5713517, 1.0, 1.88139998, 0.0],
    "smpte240": [1.0, 0.0, 1.5756, 1.0, -0.2253495, -0.4767712, 1.0, 1.8270219, 0.0],
}
SRGB_TO_XYZ = [0.4124564, 0.3575761, 0.1804375, 0.2126729, 0.7151522, 0.072175, 0.0193339, 0.119192, 0.9503041]
XYZ_TO_SRGB = [3.2404542, -1.5371385, -0.4985314, -0.969266, 1.8760108, 0.041556, 0.0556434, -0.2040259, 1.0572252]
ILLUMINANTS: dict[str, tuple[float, float, float]] = {
    "d65": (95.047, 100.0, 108.883),
    "c": (98.074, 100.0, 118.232),
    "b": (99.0927, 100.0, 85.313),
    "d55": (95.682, 100.0, 92.149),
    "d75": (94.972, 100.0, 122.638),
    "f1": (92.834, 100.0, 103.665),
    "f2": (99.187, 100.0, 67.395),
    "f3": (103.754, 100.0, 49.861),
    "f4": (109.147, 100.0, 38.813),
    "f5": (90.872, 100.0, 98.723),
    "cool_white": (100.365, 100.0, 67.868),
}
#: The same for the standard observer of ten degrees.
ILLUMINANTS_10: dict[str, tuple[float, float, float]] = {
    "d65": (94.811, 100.0, 107.304),
    "c": (97.285, 100.0, 116.145),
    "d55": (95.799, 100.0, 90.926),
    "d75": (94.416, 100.0, 120.641),
    "f2": (103.28, 100.0, 69.026),
}
ADAPTATION: dict[str, list[float]] = {
    "cat02": [0.7328, 0.4296, -0.1624, -0.7036, 1.6975, 0.0061, 0.003, 0.0136, 0.9834],
    "von_kries": [0.40024, 0.7076, -0.08081, -0.2263, 1.16532, 0.0457, 0.0, 0.0, 0.91822],
    "bradford": [0.8951, 0.2664, -0.1614, -0.7502, 1.7135, 0.0367, 0.0389, -0.0685, 1.0296],
    "sharp": [1.2694, -0.0988, -0.1706, -0.8364, 1.8006, 0.0357, 0.0297, -0.0315, 1.0018],
    "cmccat2000": [0.7982, 0.3389, -0.1371, -0.5918, 1.5512, 0.0406, 0.0008, 0.0239, 0.9753],
}
SEPIA = [0.393, 0.769, 0.189, 0.349, 0.686, 0.168, 0.272, 0.534, 0.131]
#: The 16 colours of the classic digital palette: levels 0, 170 and 85 more when bright, brown for dark yellow.
CGA16 = [(170 * (i >> 2 & 1) + 85 * (i >> 3), (85 if i == 6 else 170 * (i >> 1 & 1)) + 85 * (i >> 3), 170 * (i & 1) + 85 * (i >> 3)) for i in range(16)]
#: The 64 colours of two bits a channel: the low bit of a colour's number gives 170, the high one 85 more.
EGA64 = [tuple(170 * (i >> k & 1) + 85 * (i >> (k + 3) & 1) for k in (2, 1, 0)) for i in range(64)]


def _vga256() -> list[tuple[int, int, int]]:
    """The 256 colours that the 6-bit palette starts with: 16 classic ones, 16 greys, 24 hues at three saturations and three values, 8 blacks."""
    up = lambda v: round(v * 255 / 63)
    greys = [0, 5, 8, 11, 14, 17, 20, 24, 28, 32, 36, 40, 45, 50, 56, 63]
    out = [*CGA16, *((up(v),) * 3 for v in greys)]
    for high in (63, 28, 16):
        for low in ((0, 31, 45), (0, 14, 20), (0, 8, 11))[(63, 28, 16).index(high)]:
            ramp = [low + (2 * (high - low) * i + 3) // 8 for i in range(5)]  # quarters, halves rounded down
            for hue in range(24):
                # from blue over red and green back to blue: in each sixth one channel rises or falls
                sixth, i = divmod(hue, 4)
                r, g, b = ((ramp[i], low, high), (high, low, ramp[4 - i]), (high, ramp[i], low), (ramp[4 - i], high, low), (low, high, ramp[i]), (low, ramp[4 - i], high))[sixth]
                out.append((up(r), up(g), up(b)))
    return [*out, *[(0, 0, 0)] * 8]


#: Palettes of old screens and games: fixed values, red, green, blue.
CGA: dict[str, list[tuple[int, int, int]]] = {
    "cga0": [(0, 0, 0), (0, 170, 170), (170, 0, 170), (255, 255, 255)],
    "cga0_bright": [(0, 0, 0), (85, 255, 255), (255, 85, 255), (255, 255, 255)],
    "cga1": [(0, 0, 0), (0, 170, 0), (170, 0, 0), (170, 85, 0)],
    "cga1_bright": [(0, 0, 0), (85, 255, 85), (255, 85, 85), (255, 255, 85)],
}
EGA: dict[str, list[tuple[int, int, int]]] = {
    "ega_kq3": [
        (0, 0, 0), (0, 0, 128), (0, 80, 0), (0, 80, 80), (128, 0, 0), (128, 0, 128), (128, 64, 0), (170, 170, 170),
        (85, 85, 85), (85, 85, 255), (85, 200, 85), (85, 200, 200), (200, 85, 85), (200, 85, 200), (255, 255, 85), (255, 255, 255),
    ],
    "ega_kyrandia": [
        (0, 0, 0), (0, 0, 140), (0, 100, 0), (0, 100, 100), (140, 0, 0), (140, 0, 140), (140, 70, 0), (160, 160, 160),
        (88, 80, 80), (80, 80, 150), (80, 200, 80), (80, 200, 200), (255, 50, 50), (255, 50, 255), (255, 255, 80), (255, 255, 255),
    ],
    "ega_thexder": [
        (0, 0, 0), (85, 0, 85), (50, 85, 50), (0, 170, 170), (170, 0, 0), (170, 0, 170), (170, 85, 0), (170, 170, 170),
        (85, 85, 85), (85, 85, 255), (85, 255, 85), (85, 255, 255), (255, 85, 85), (255, 85, 255), (255, 255, 80), (255, 255, 255),
    ],
    "ega_dune": [
        (0, 0, 0), (0, 0, 80), (40, 80, 80), (0, 80, 80), (120, 40, 40), (120, 40, 120), (140, 100, 60), (100, 100, 100),
        (80, 80, 80), (80, 80, 160), (80, 120, 80), (80, 120, 120), (200, 80, 60), (160, 80, 160), (200, 160, 80), (220, 200, 160),
    ],
    "ega_doom": [
        (0, 0, 0), (40, 40, 40), (80, 70, 60), (40, 80, 40), (120, 0, 0), (80, 0, 80), (100, 60, 40), (100, 100, 100),
        (60, 80, 80), (40, 40, 60), (0, 200, 0), (0, 120, 120), (255, 40, 40), (160, 0, 160), (255, 255, 0), (255, 255, 255),
    ],
    "ega_metal_mutant": [
        (0, 0, 0), (0, 80, 0), (0, 120, 0), (0, 100, 80), (80, 80, 80), (120, 120, 120), (160, 160, 160), (0, 0, 100),
        (50, 50, 120), (80, 200, 80), (80, 200, 200), (160, 80, 40), (200, 0, 0), (255, 0, 0), (200, 160, 0), (255, 255, 255),
    ],
    "ega_wolfenstein": [
        (0, 0, 0), (50, 50, 50), (80, 70, 60), (100, 70, 40), (120, 0, 0), (100, 50, 40), (150, 60, 40), (180, 120, 80),
        (100, 100, 100), (160, 160, 160), (80, 100, 80), (70, 80, 100), (255, 0, 0), (200, 160, 80), (255, 255, 80), (255, 255, 255),
    ],
}
#: The whites of the one-colour screen, from pure to bluish: fixed values.
HERCULES_WHITES = [(255, 255, 255), (250, 250, 255), (245, 245, 255)]


def _desktop256() -> list[tuple[int, int, int]]:
    """The 256 colours of an old desktop: ten fixed ones first and last, between them a lattice of levels that begins and ends within its row of red 42."""
    first = [(0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128), (128, 0, 128), (0, 128, 128), (192, 192, 192), (192, 220, 192), (166, 202, 240)]
    last = [(255, 251, 240), (160, 160, 164), (128, 128, 128), (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 255)]
    extra = [(204, 204, 255), (255, 204, 255), (51, 255, 255), (102, 255, 255), (153, 255, 255), (204, 255, 255)]
    levels = [(r, g, b) for r in (0, 42, 85, 127, 170, 212, 255) for g in (0, 31, 63, 95, 127, 159, 191, 223, 255) for b in (0, 85, 170, 255)]
    lattice = [c for c in levels if c not in {*first, *last}]
    cut = lattice.index((42, 63, 170))
    return [*first, *lattice[cut:], *extra, *(c for c in lattice[:cut] if c[0] or c[1] >= 127), *last]


PALETTES: dict[str, list[tuple[int, int, int]]] = {"cga16": CGA16, "ega64": EGA64, "vga256": _vga256(), **CGA, "ega_standard": CGA16, **EGA, "vga16": CGA16, "desktop256": _desktop256()}


def white_point(illuminant: str, observer: int = 2) -> tuple[float, float, float]:
    """X, Y, Z of an illuminant for the observer of 2 or 10 degrees."""
    if observer not in (2, 10):
        raise ValueError("observers are 2 and 10")
    return (ILLUMINANTS if observer == 2 else ILLUMINANTS_10)[illuminant]


def mask(shape: str, size: int) -> list[tuple[int, int]]:
    """(dy, dx) of the cells of a structuring element."""
    r = size // 2
    rule = {
        "square": lambda dy, dx: True, "vertical": lambda dy, dx: dx == 0, "horizontal": lambda dy, dx: dy == 0,
        "cross": lambda dy, dx: dy == 0 or dx == 0, "diamond": lambda dy, dx: abs(dy) + abs(dx) <= r,
    }
    span = range(-r, r + 1)
    if (shape, size) in MASKS:
        return [(dy, dx) for dy in span for dx in span if MASKS[shape, size][dy + r][dx + r] == "1"]
    return [(dy, dx) for dy in span for dx in span if rule[shape](dy, dx)]


def kernel(name: str) -> tuple[list[tuple[int, int, int]], int]:
    """((dy, dx, weight) without zeros, normaliser)."""
    rows, norm = KERNELS[name]
    r = len(rows) // 2
    return [(y - r, x - r, w) for y, row in enumerate(rows) for x, w in enumerate(row) if w], norm


def register_kernel(name: str, rows: list[list[int]], norm: int = 1) -> None:
    """Adds a kernel; it then has the same standing as those above."""
    if len(rows) % 2 == 0 or any(len(r) != len(rows) for r in rows) or not norm:
        raise ValueError("a kernel is square, of odd size, with a normaliser")
    KERNELS[name] = (rows, norm)


def register_se(name: str, rows: list[str]) -> None:
    """Adds a structuring element of one size."""
    if len(rows) % 2 == 0 or any(len(r) != len(rows) for r in rows):
        raise ValueError("a structuring element is square and of odd size")
    MASKS[name, len(rows)] = rows


def register_palette(name: str, rows: list[tuple[int, int, int]]) -> None:
    """Adds a palette."""
    PALETTES[name] = rows


def kernels(spark: SparkSession) -> DataFrame:
    """kernel, dy, dx, w, norm"""
    return spark.createDataFrame([(n, *c, kernel(n)[1]) for n in KERNELS for c in kernel(n)[0]], "kernel string, dy int, dx int, w int, norm int")


def palette(spark: SparkSession, name: str) -> DataFrame:
    """idx, pr, pg, pb"""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTES[name])], "idx int, pr int, pg int, pb int")
