"""Fixed values.

Everything in this file must hold exactly these values for results to be right:
the vocabulary of the logs, the crop and resistance parameters, and the limits
of the decision rules.
"""

# Vocabulary of the logs (fixed values).
STRATEGIES = ("none", "calendar", "threshold")
DEFAULT_COMPOUND = "starfarm"
COMPOUND_A = "etofenprox"
COMPOUND_B = "neonicotinoid"
COMPOUNDS = (DEFAULT_COMPOUND, COMPOUND_A, COMPOUND_B)
REACTIVE = "REACTIVE"

# Compounds: name, efficacy, selection pressure, cost per spray (fixed values).
COMPOUND_ROWS = (
    ("etofenprox", 0.7, 0.015, 110.6),
    ("neonicotinoid", 0.8, 0.025, 100.0),
)
DEFAULT_EFFICACY = 0.8
DEFAULT_PRESSURE = 0.02
DEFAULT_COST = 100.0

# Money (fixed values).
GRAIN_PRICE = 3000.0
START_MONEY = 5000.0

# Crop growth (fixed values).
# Stage rows: stage, heat units from (inclusive), heat units to (exclusive),
# intercepted light share, damage weight.
STAGE_ROWS = (
    (1, 0.0, 70.0, 0.2, 0.7),
    (2, 70.0, 920.0, 0.7, 0.6),
    (3, 920.0, 1350.0, 0.9, 0.5),
    (4, 1350.0, 1000000000.0, 0.85, 0.3),
)
MATURITY_HEAT = 1350.0
BASE_TEMPERATURE = 10.0
LIGHT_USE = 0.768
MIN_GROWTH = 0.5
HARVEST_INDEX = 0.52
BIOMASS_TO_THA = 0.01
PEST_FREE_THA = 4.0075776

# Pest pressure (fixed values).
HUMIDITY_LIMIT = 80.0
TEMPERATURE_LIMIT = 27.0
BAND_HEALTHY = 0.1
BAND_LIGHT = 0.4
BAND_MODERATE = 0.7
DIFFUSION_SHARE = 0.1

# Field grid (fixed values).
GRID_WIDTH = 10
GRID_HEIGHT = 10
OUTBREAK_X = 4
OUTBREAK_Y = 4

# Spray decisions (fixed values).
SPRAY_COOLDOWN = 7
SPRAY_INTERVAL = 14
SPRAY_THRESHOLD = 0.3

# Resistance: sprays up to EARLY count half, beyond LATE count 2.5 times (fixed values).
EARLY_SPRAYS = 3
LATE_SPRAYS = 7
EARLY_FACTOR = 0.5
MIDDLE_FACTOR = 1.0
LATE_FACTOR = 2.5
IMMIGRATION_RATE = 0.05
FITNESS_COST = 0.0
SPILLOVER = 0.0
FIXATION_RF = 0.99

# Adaptive rules (fixed values).
INTERVAL_STEP = 2
INTERVAL_CAP = 28
INTERVAL_FLOOR = 1
THRESHOLD_STEP = 0.05
THRESHOLD_CAP = 0.5
THRESHOLD_FLOOR = 0.1
SWAP_CYCLE = ("calendar", "threshold", "none")
SWAP_RF = 0.5

# Tests (fixed values).
ALPHA = 0.05
