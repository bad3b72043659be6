"""Values that the results depend on, in one place."""

#: Travel-time bands in minutes and their published zonal weights (fixed values).
BAND_WEIGHTS = {30: 1.00, 60: 0.68, 120: 0.22, 180: 0.09}
#: Named decay schemes over the same bands (fixed values).
DECAY_SCHEMES = {
    "base": {30: 1.00, 60: 0.68, 120: 0.22, 180: 0.09},
    "steeper": {30: 1.00, 60: 0.50, 120: 0.10, 180: 0.02},
    "flatter": {30: 1.00, 60: 0.85, 120: 0.55, 180: 0.30},
}
GAUSSIAN_SIGMA = 60.0
PER_CAPITA = 1e5
#: Providers per 100,000 at which population shares are reported.
THRESHOLDS = (0.0, 1.0, 5.0, 10.0, 20.0, 50.0)
STATE_LOSS = 0.05
#: Exclusive bounds of the contiguous states.
CONUS_LON, CONUS_LAT = (-125.0, -66.0), (24.0, 50.0)
EARTH_KM = 6371.0088
EARLY_CAREER_YEARS, SURFACE_KM = 15, 5.0
LOW_SPAR = 0.5
REACHED_PERCENT = 50.0
#: Relative and absolute tolerances of the seam test.
SEAM_MEAN, SEAM_SHARE = 0.02, 0.01
EQUITY_CUTS = (0.90, 1.10)
CLAIM_LEVEL, MATERIAL_CHANGE = 0.5, 0.25
#: Double-precision epsilon, as a floor of denominators.
EPSILON = 2.220446049250313e-16
#: Survey variables of women: all, and by group (fixed values).
TOTAL_FEMALE = "B01001_026"
RACE_FEMALE = {"white_nh": "B01001H_017", "black": "B01001B_017", "hispanic": "B01001I_017", "asian": "B01001D_017", "aian": "B01001C_017", "nhpi": "B01001E_017"}
#: Certifications and the specialty that they count for (fixed values).
SPECIALTY_CODES = {
    "Gynecologic Oncology": "GO",
    "CRI": "GO",
    "Hospice and Palliative Medicine": "GO",
    "Maternal-Fetal Medicine": "MFM",
    "Reproductive Endocrinology and Infertility": "REI",
    "Female Pelvic Medicine & Reconstructive Surgery": "FPMRS",
    "MIG": "MIGS",
    "Pediatric & Adolescent Gynecology": "PAG",
    "Complex Family Planning": "CFP",
}
#: Age bands of demand by the survey's columns from and to (fixed values).
AGE_BANDS = {"adult_18p": (31, 49), "repro_1544": (30, 38), "repro_1549": (30, 39), "age_1854": (31, 40), "girls_019": (27, 31), "age_40p": (38, 49)}
#: Words that claim a standard of need, which access has none of (fixed values).
NORMATIVE_TERMS = ("shortage", "surplus", "adequacy", "adequate", "inadequate", "unmet need", "unmet needs", "need met", "needs met", "undersupply", "oversupply", "under-supply", "over-supply", "sufficient", "insufficient")
