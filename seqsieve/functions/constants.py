"""Fixed values of the variant library."""

from __future__ import annotations

# The wild type (141 bases), the sites that may differ from it (from 1), their roles and partners.
WILD_TYPE = "UAUCCUUCGGGGCAGGGUGGAAAUCCCGACCGGCGGUAGUAAAGCACAUUUGCUUUAGAGCCCGUGACCCGUGUGCAUAAGCACGCGGUGGAUUCAGUUUAAGCUGAAGCCGACAGUGAAAGUCUGGAUGGGAGAAGGAUG"
SITES = (30, 31, 32, 33, 89, 90, 91, 92, 127, 128, 129, 130, 131)
CLUSTERS = ((30, 31, 32, 33), (89, 90, 91, 92), (127, 128, 129, 130, 131))
BASES = "ACGU"
ROLES = {30: "stem", 31: "stem", 32: "stem", 33: "junction", 89: "loop", 90: "loop", 91: "loop", 92: "junction", 127: "stem", 128: "stem", 129: "stem", 130: "junction", 131: "loop"}
PAIRS = {30: 33, 31: 32, 32: 31, 33: 30, 90: 92, 92: 90, 127: 131, 131: 127, 128: 130, 130: 128}

# Stacking energies of two neighbouring bases, and chemical classes of a base
# (purine, pyrimidine, strong, weak, keto, amino).
STACKING = {
    "AA": -0.93, "AU": -1.10, "AC": -1.44, "AG": -1.81,
    "UA": -1.33, "UU": -0.93, "UC": -1.39, "UG": -1.45,
    "CA": -1.45, "CU": -1.39, "CC": -1.84, "CG": -2.17,
    "GA": -1.30, "GU": -1.39, "GC": -2.24, "GG": -1.84,
}
PROPERTIES = {"A": (1, 0, 0, 1, 0, 1), "C": (0, 1, 1, 0, 0, 1), "G": (1, 0, 1, 0, 1, 0), "U": (0, 1, 0, 1, 1, 0)}

# Weights of the hybrid label, and the tolerances of its check.
HYBRID_GAP, HYBRID_ENERGY = 0.961, 0.039
LABEL_TOLERANCE, GAP_TOLERANCE, RELATIVE_TOLERANCE = 0.01, 0.1, 1e-5

#: Runs of neighbouring sites: (first site, length).
RUNS = ((30, 4), (89, 4), (127, 5))
