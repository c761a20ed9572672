"""Fixed values the results have to agree with: published definitions, and presets, radii and labels of the domain."""

# --- fixed values: CSS Color Level 4 named colours -------------------------------------------------
NAMED_COLORS = """
aliceblue f0f8ff
antiquewhite faebd7
aqua 00ffff
aquamarine 7fffd4
azure f0ffff
beige f5f5dc
bisque ffe4c4
black 000000
blanchedalmond ffebcd
blue 0000ff
blueviolet 8a2be2
brown a52a2a
burlywood deb887
cadetblue 5f9ea0
chartreuse 7fff00
chocolate d2691e
coral ff7f50
cornflowerblue 6495ed
cornsilk fff8dc
crimson dc143c
cyan 00ffff
darkblue 00008b
darkcyan 008b8b
darkgoldenrod b8860b
darkgray a9a9a9
darkgreen 006400
darkgrey a9a9a9
darkkhaki bdb76b
darkmagenta 8b008b
darkolivegreen 556b2f
darkorange ff8c00
darkorchid 9932cc
darkred 8b0000
darksalmon e9967a
darkseagreen 8fbc8f
darkslateblue 483d8b
darkslategray 2f4f4f
darkslategrey 2f4f4f
darkturquoise 00ced1
darkviolet 9400d3
deeppink ff1493
deepskyblue 00bfff
dimgray 696969
dimgrey 696969
dodgerblue 1e90ff
firebrick b22222
floralwhite fffaf0
forestgreen 228b22
fuchsia ff00ff
gainsboro dcdcdc
ghostwhite f8f8ff
gold ffd700
goldenrod daa520
gray 808080
green 008000
greenyellow adff2f
grey 808080
honeydew f0fff0
hotpink ff69b4
indianred cd5c5c
indigo 4b0082
ivory fffff0
khaki f0e68c
lavender e6e6fa
lavenderblush fff0f5
lawngreen 7cfc00
lemonchiffon fffacd
lightblue add8e6
lightcoral f08080
lightcyan e0ffff
lightgoldenrodyellow fafad2
lightgray d3d3d3
lightgreen 90ee90
lightgrey d3d3d3
lightpink ffb6c1
lightsalmon ffa07a
lightseagreen 20b2aa
lightskyblue 87cefa
lightslategray 778899
lightslategrey 778899
lightsteelblue b0c4de
lightyellow ffffe0
lime 00ff00
limegreen 32cd32
linen faf0e6
magenta ff00ff
maroon 800000
mediumaquamarine 66cdaa
mediumblue 0000cd
mediumorchid ba55d3
mediumpurple 9370db
mediumseagreen 3cb371
mediumslateblue 7b68ee
mediumspringgreen 00fa9a
mediumturquoise 48d1cc
mediumvioletred c71585
midnightblue 191970
mintcream f5fffa
mistyrose ffe4e1
moccasin ffe4b5
navajowhite ffdead
navy 000080
oldlace fdf5e6
olive 808000
olivedrab 6b8e23
orange ffa500
orangered ff4500
orchid da70d6
palegoldenrod eee8aa
palegreen 98fb98
paleturquoise afeeee
palevioletred db7093
papayawhip ffefd5
peachpuff ffdab9
peru cd853f
pink ffc0cb
plum dda0dd
powderblue b0e0e6
purple 800080
rebeccapurple 663399
red ff0000
rosybrown bc8f8f
royalblue 4169e1
saddlebrown 8b4513
salmon fa8072
sandybrown f4a460
seagreen 2e8b57
seashell fff5ee
sienna a0522d
silver c0c0c0
skyblue 87ceeb
slateblue 6a5acd
slategray 708090
slategrey 708090
snow fffafa
springgreen 00ff7f
steelblue 4682b4
tan d2b48c
teal 008080
thistle d8bfd8
tomato ff6347
turquoise 40e0d0
violet ee82ee
wheat f5deb3
white ffffff
whitesmoke f5f5f5
yellow ffff00
yellowgreen 9acd32
"""
NAMED = [tuple(line.split()) for line in NAMED_COLORS.split("\n") if line]

# --- fixed values: RGB hue at every 15 degrees of the red-yellow-blue artist wheel --------------------
RYB_RGB_HUES = [
    0, 8, 17, 26, 34, 41, 48, 54, 60, 81, 103, 123, 138,
    155, 171, 187, 204, 219, 234, 251, 267, 282, 298, 329, 360,
]

# --- fixed values: channel mixing for colour-vision deficiencies, in thousandths -----------------------
CVD_KINDS = ["protan", "deutan", "tritan", "achroma"]
CVD_MATRICES = {
    "protan": [[567, 433, 0], [558, 442, 0], [0, 242, 758]],
    "deutan": [[625, 375, 0], [700, 300, 0], [0, 300, 700]],
    "tritan": [[950, 50, 0], [0, 433, 567], [0, 475, 525]],
    "achroma": [[299, 587, 114], [299, 587, 114], [299, 587, 114]],
}

# --- fixed values: mood presets ------------------------------------------------------------------------
# name: min L, max L, min chroma, max chroma (0 = unbounded), saturation bias, exponent, L preference
MOOD_PRESETS = {
    "default": (0.10, 0.92, 0.02, 0.0, 0.5, 1.2, 0.0),
    "colorful": (0.15, 0.90, 0.08, 0.0, 0.3, 2.0, 0.0),
    "bright": (0.55, 0.95, 0.06, 0.0, 0.4, 1.5, 0.5),
    "muted": (0.20, 0.85, 0.01, 0.10, 1.5, 0.4, 0.0),
    "deep": (0.20, 0.60, 0.10, 0.0, 0.3, 1.8, -0.3),
    "dark": (0.05, 0.45, 0.04, 0.0, 0.5, 1.2, -0.6),
}

# --- fixed values: harmony offsets in artist-wheel degrees ------------------------------------------------
HARMONY_OFFSETS = {
    "complementary": [0, 180],
    "triadic": [0, 120, 240],
    "split-complementary": [0, 199, 161],
    "tetradic": [0, 90, 180, 270],
    "square": [0, 90, 180, 270],
    "double-complementary": [0, 38, 180, 218],
    "compound": [0, -30, -150, 180],
}
HARMONY_ALIASES = {"split": "split-complementary", "double": "double-complementary"}
HARMONY_TYPES = [*HARMONY_OFFSETS, "analogous", "monochromatic", "shades"]

# --- fixed values: shade-scale labels -------------------------------------------------------------------
SHADE_LABELS = {
    5: [100, 300, 500, 700, 900],
    10: [50, 100, 200, 300, 400, 500, 600, 700, 800, 900],
}

# --- fixed values: OkLab (Ottosson 2020) -------------------------------------------------------------------
OKLAB_LMS = [
    [0.4122214708, 0.5363325363, 0.0514459929],
    [0.2119034982, 0.6806995451, 0.1073969566],
    [0.0883024619, 0.2817188376, 0.6299787005],
]
OKLAB_FROM_LMS = [
    [0.2104542553, 0.7936177850, -0.0040720468],
    [1.9779984951, -2.4285922050, 0.4505937099],
    [0.0259040371, 0.7827717662, -0.8086757660],
]
OKLAB_TO_LMS = [
    [0.3963377774, 0.2158037573],
    [-0.1055613458, -0.0638541728],
    [-0.0894841775, -1.2914855480],
]
OKLAB_LMS_TO_RGB = [
    [4.0767416621, -3.3077115913, 0.2309699292],
    [-1.2684380046, 2.6097574011, -0.3413193965],
    [-0.0041960863, -0.7034186147, 1.7076147010],
]

# --- fixed values: sRGB <-> CIE XYZ, D65 white -----------------------------------------------------------------
RGB_TO_XYZ = [
    [0.41239079926595948, 0.35758433938387796, 0.18048078840183429],
    [0.21263900587151036, 0.71516867876775593, 0.072192315360733715],
    [0.019330818715591851, 0.11919477979462599, 0.95053215224966058],
]
XYZ_TO_RGB = [
    [3.2409699419045214, -1.5373831775700935, -0.49861076029300328],
    [-0.96924363628087983, 1.8759675015077207, 0.041555057407175613],
    [0.055630079696993609, -0.20397695888897657, 1.0569715142428786],
]
D65 = [0.95047, 1.0, 1.08883]

# --- fixed values: relative luminance and APCA 0.0.98G-4g weights ----------------------------------------------
LUMA = [0.2126, 0.7152, 0.0722]
APCA_LUMA = [0.2126729, 0.7151522, 0.0721750]

# --- fixed values: extraction defaults ----------------------------------------------------------------------------
PALETTE_SIZE = 5
MAX_PALETTE_SIZE = 32
RESIZE_SIDE = 512
CLUSTERS_PER_COLOR = 5
SOFT_MERGE_DISTANCE = 12.0
WEIGHTED_MERGE_DISTANCE = 8.0
DENSITY_RADIUS = 6.0
DENSITY_MIN_PIXELS = 4
SALIENCY_POWER = 1.5
SALIENCY_FLOOR = 0.05
LLOYD_ROUNDS = 50
