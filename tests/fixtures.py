"""Inputs and expected values of recorded runs, as literals."""

LABELS = {"C 0100 FDN DE": "Tierlieber Waldläufer", "C 0214 FDN DE": "Gebrochene Flügel", "U 0125 FDN DE": "Wächter des Kreislaufs"}

#: raw, cleaned, raw score, cleaned score, final text, (set, number, language)
TEXTS = [
    ("AS C 0100 FON + DE", "A5 C 0100 F0N DE", 60, 60, "A5 C 0100 F0N DE", None),
    ("RESEDENN C 0100 FDN DE", "RE5EDEN C 0100 FDN DE", 110, 110, "RE5EDEN C 0100 FDN DE", ("FDN", "0100", "DE")),
    ("LER U 0125 FDN +DE |", "LER U 0125 FDN DE 1", 110, 110, "LER U 0125 FDN DE 1", ("FDN", "0125", "DE")),
    ("LER u 0128 FDN DE |", "LER U 0128 FDN DE 1", 95, 110, "LER U 0128 FDN DE 1", ("FDN", "0128", "DE")),
    ("C 0100 FDN «DE", "C 0100 FDN DE", 95, 95, "C 0100 FDN DE", ("FDN", "0100", "DE")),
    ("A U 01285 FON °DI |", "A U 01285 F0N D1 1", 50, 50, "A U 01285 F0N D1 1", None),
    ("Cc 0100 FDN DE", "C 0100 FDN DE", 95, 95, "C 0100 FDN DE", ("FDN", "0100", "DE")),
    ("U 0012 DSK ES", "U 0012 D5K E5", 95, 35, "U 0012 DSK ES", ("DSK", "0012", "ES")),
    ("R 0042 OTJ IT", "R 0042 0TJ 1T", 95, 35, "R 0042 OTJ IT", ("OTJ", "0042", "IT")),
    ("M 00001 LCI EN", "M 01 LC1 EN", 95, 15, "M 00001 LCI EN", ("LCI", "00001", "EN")),
    ("x R 1111 BLB EN\n", "X R 1 BLB EN", 110, 80, "x R 1111 BLB EN\n", ("BLB", "1111", "EN")),
    ("", "", 0, 0, "", None),
    ("FDN", "FDN", 50, 50, "FDN", None),
]

#: (texts recognised per file stem, in the order of the configurations) with their accuracies, basic run
BASIC = {
    "C 0100 FDN DE": [("Rss c 0100 FON + DE |", 4.761904761904762)] * 4 + [("AS C 0100 FON + DE", 9.523809523809524)] * 3 + [("Rss c 0100 FON + DE |", 4.761904761904762)] * 3 + [("AS C 0100 FON + DE", 9.523809523809524)],
    "C 0214 FDN DE": [("— c 0214 FON «DE", 5.88235294117647)] * 4 + [("VE C 0214 FON -DE NM", 15)] * 3 + [("— C 0214 FON «DE NM", 5.263157894736842)] * 2 + [("— c 0214 FON «DE", 5.88235294117647), ("VE C 0214 FON -DE NM", 15)],
    "U 0125 FDN DE": [("— Uv 0128 FON + DE |", 4.545454545454546)] * 4 + [("LER U 0125 FDN +DE |", 4.545454545454546)] * 3 + [("— U 0128 FON + DE |", 4.545454545454546)] * 2 + [("— Uv 0128 FON + DE |", 4.545454545454546), ("LER U 0125 FDN +DE |", 4.545454545454546)],
}

#: configuration, preprocessing in the order of the advanced run
ADVANCED_CONFIGS = [
    ("German Standard", "none"), ("German High Contrast", "contrast"), ("German Inverted", "invert"), ("German Upscaled", "upscale"), ("German Sharpen", "sharpen"), ("English Standard", "none"),
    ("English High Contrast", "contrast"), ("Multi-lang Standard", "none"), ("Multi-lang Contrast", "contrast"), ("German Block Text", "contrast"), ("German Single Word", "contrast"), ("German Letters Only", "contrast"),
]
ADVANCED = {
    "C 0100 FDN DE": [("AS C 0100 FON + DE", 9.523809523809524), ("RESEDENN C 0100 FDN DE", 9.090909090909092), ("AS C 0100 FON + DE", 9.523809523809524), ("KEN C 0100 FON «DE", 9.523809523809524), ("C 0100 FDN «DE", 19.047619047619047),
                      ("Rss c 0100 FON + DE |", 4.761904761904762), ("ES c 0100 FON + DE |", 4.761904761904762), ("Rss c 0100 FON + DE |", 4.761904761904762), ("ES c 0100 FON + DE |", 4.761904761904762)] + [("RESEDENN C 0100 FDN DE", 9.090909090909092)] * 3,
    "C 0214 FDN DE": [("VE C 0214 FON -DE NM", 15), ("| C 0214 FON -DE I", 5.555555555555555), ("VE (SCHE FON -DE NM", 26.31578947368421), ("| C 0214 FON-DEN", 11.76470588235294), ("VA C 0214 FON-«DE N", 10.526315789473683),
                      ("— c 0214 FON «DE", 5.88235294117647), ("SE c 0214 FON «OE", 11.76470588235294), ("— C 0214 FON «DE NM", 5.263157894736842), ("SE c 0214 FON «OE I", 15.789473684210526)] + [("| C 0214 FON -DE I", 5.555555555555555)] * 3,
    "U 0125 FDN DE": [("LER U 0125 FDN +DE |", 4.545454545454546), ("LER u 0128 FDN DE |", 9.090909090909092), ("LER U 0125 FDN +DE |", 4.545454545454546), ("A U 01285 FON °DI |", 4.545454545454546), ("EEE U 0125 FDN °Dd |", 4.545454545454546),
                      ("— Uv 0128 FON + DE |", 4.545454545454546), ("— v 0128 FON + DE |", 4.545454545454546), ("— U 0128 FON + DE |", 4.545454545454546), ("LER u 0128 FDN + DE |", 4.545454545454546)] + [("LER u 0128 FDN DE |", 9.090909090909092)] * 3,
}
