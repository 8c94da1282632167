"""Fixed values of the ranking metric and the ingest policy, in one place."""

#: weights and widths of the role score
SERIF_BONUS, XH_WEIGHT, WIDTH_WEIGHT, BODY_LEGIBILITY = 0.2, 0.5, 0.5, 0.5
XH_SIGMA, XH_SPAN, WIDTH_SPAN, WEIGHT_SPAN = 0.05, 0.15, 0.3, 400.0
#: body weights that a body slot accepts
BODY_MIN, BODY_MAX = 300, 700
#: candidate cuts of the joint search, and the weight of legibility in its objective
BODY_CUT, ACCENT_CUT, TRIPLE_LEGIBILITY = 40, 80, 0.25
#: nearest graph headings, partners averaged, neighbours of typicality
GRAPH_NEAR, GRAPH_PARTNERS, TYPICAL_NEAR = 10, 10, 20
#: weights that a variable face is expanded to
LADDER = (300, 400, 700, 900)
#: scripts whose families don't pair with Latin text
CJK_SCRIPTS = ("Jpan", "Kore", "Hans", "Hant", "Hani")
#: sources that a public release may hold
PUBLIC_SOURCES = ("google", "local")

# Fixed values of the label ingest: word lists, renames and marks that names are read with.

#: last words that name a weight or style of a family, and what may stand before them with a hyphen
CUT_WORDS = ("thin", "light", "regular", "medium", "bold", "black", "heavy", "book", "demi", "italic", "roman")
CUT_PREFIXES = ("ultra", "extra", "semi")
#: words by which related families of one design differ
CLASS_WORDS = ("sans", "serif", "mono", "slab", "display", "text", "gothic", "grotesk", "grotesque", "condensed", "expanded", "narrow", "rounded", "sc", "pro")
#: families that changed their name
RENAMED = {"Source Sans Pro": "Source Sans 3", "Source Serif Pro": "Source Serif 4"}
#: open families that stand for a named one in records of use, by lower-case name
STAND_INS = {
    "futura": "Jost", "franklin gothic": "Libre Franklin", "times new roman": "Tinos", "times": "Tinos", "arial": "Arimo", "georgia": "Gelasio", "bodoni": "Bodoni Moda",
    "baskerville": "Libre Baskerville", "courier": "Courier Prime", "caslon": "Libre Caslon Text", "adobe caslon": "Libre Caslon Text",
}
#: channel means and deviations of the image backbones
CHANNEL_MEAN = (103.939, 116.779, 123.68)
UNIT_MEAN, UNIT_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: features of the body and heading slots that a screened axis adds at this weight, and the span of a plain face
SCREEN_WEIGHT, PLAIN_SPAN = 0.5, 0.3
