"""Domain constants."""

# fixed values: label orders, alphabets, framing
SPECIES = ["escherichia coli", "pseudomonas aeruginosa", "klebsiella pneumoniae", "staphylococcus aureus", "bacillus subtilis", "staphylococcus epidermidis"]
OBJECTS = ["LIPID BILAYER", "DNA / RNA", "CYTOPLASMIC PROTEIN", "MEMBRANE PROTEIN", "OTHER"]
GROUPS = ["GRAM-", "GRAM+", "MAMMALIAN CELL", "FUNGUS", "OTHER"]
L_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
D_RESIDUES = "acfhiklnpqrstvwy"
PREFIX, SUFFIX = "<nblank><SOS>", "<EOS><cblank>"
SPECIAL_TOKENS = ["<blank>", "<MASK>"]
MAX_LENGTH = 68

# fixed values: property scales (Eisenberg hydrophobicity, Boman solubility, Kyte-Doolittle hydropathy)
EISENBERG = {
    "A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06,
    "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26,
}
BOMAN = {
    "A": 0.31, "C": -1.28, "D": 4.87, "E": 3.54, "F": -2.98, "G": 0.74, "H": 3.01, "I": -4.92, "K": 4.21, "L": -4.92,
    "M": -2.35, "N": 3.22, "P": 2.14, "Q": 3.17, "R": 4.53, "S": 1.24, "T": 1.08, "V": -4.04, "W": -2.33, "Y": 1.68,
}
KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# fixed values: pK of side chains and termini (Bjellqvist et al., 1993 and 1994)
PK_BASE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_ACID = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERM, PK_C_TERM = 7.5, 3.55
PK_N_TERM_BY_RESIDUE = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_TERM_BY_RESIDUE = {"D": 4.55, "E": 4.75}

# fixed values: ranking (desirability of hydropathy; weights by profile)
GRAVY_TARGET, GRAVY_SIGMA = -0.30, 0.15
SECONDARY_WEIGHTS = {"success_rate": 0.04, "novelty_rate": 0.03, "repeat_rate_inv": 0.03}
PROFILE_WEIGHTS = {
    "balanced": {"mean_charge_score": 0.18, "mean_alpha_score": 0.18, "mean_beta_score": 0.18, "mean_boman_index": 0.18, "s_gravy": 0.18},
    "alpha_focus": {"mean_charge_score": 0.18, "mean_alpha_score": 0.36, "mean_beta_score": 0.0, "mean_boman_index": 0.18, "s_gravy": 0.18},
    "beta_focus": {"mean_charge_score": 0.18, "mean_alpha_score": 0.0, "mean_beta_score": 0.36, "mean_boman_index": 0.18, "s_gravy": 0.18},
}
LINEAR_METRICS = ["mean_charge_score", "mean_alpha_score", "mean_beta_score", "mean_boman_index", "success_rate", "novelty_rate", "repeat_rate"]
