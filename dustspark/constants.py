"""Fixed values. Results depend on them, so they are stated once, here, and nowhere else."""

from __future__ import annotations

# Site catalogue
# (id, name, province, climate, training region, lat, lon, elevation m, capacity MWp)
SITES = [
    ("sakaka", "Sakaka Solar PV", "Al Jouf", "inland", "north", 29.97, 40.20, 559.0, 300),
    ("sudair", "Sudair Solar PV", "Riyadh Province", "inland", "central", 25.55, 45.55, 807.0, 1500),
    ("riyadh", "Riyadh (industrial)", "Riyadh Province", "inland", "central", 24.71, 46.67, 624.0, 50),
    ("jeddah", "Jeddah (Red Sea)", "Makkah Province", "west", "west", 21.49, 39.19, 13.0, 100),
    ("yanbu", "Yanbu Industrial City", "Madinah Province", "west", "west", 24.09, 38.06, 7.0, 120),
    ("dammam", "Dammam / Eastern Prov", "Eastern Province", "east", "east", 26.43, 50.10, 9.0, 200),
    ("jubail", "Al Jubail", "Eastern Province", "east", "east", 27.00, 49.66, 3.0, 180),
    ("neom", "NEOM", "Tabuk Province", "west", "west", 27.99, 35.25, 11.0, 400),
    ("alula", "AlUla", "Madinah Province", "inland", "northwest", 26.61, 37.92, 696.0, 60),
    ("tabuk", "Tabuk", "Tabuk Province", "inland", "northwest", 28.38, 36.57, 767.0, 90),
    ("abha", "Abha (Asir highlands)", "Asir Province", "highland", "southwest_highland", 18.22, 42.50, 2219.0, 40),
    ("shaqra", "Shaqra", "Riyadh Province", "inland", "central", 25.25, 45.25, 710.0, 30),
]
BBOX = {"south": 16.0, "north": 32.5, "west": 34.0, "east": 56.0}

# Climate parameters
# (climate, soiling rate %/day, loss ceiling, dust bias, published annual loss %, PV ratio of the year
#  curve, summer irradiation, winter irradiation)
CLIMATES = [
    ("west", 0.30, 0.85, 0.85, 15.0, 0.78, 7.2, 5.0),
    ("east", 0.80, 0.92, 1.25, 45.0, 0.78, 7.2, 5.0),
    ("inland", 0.50, 0.90, 1.05, 30.0, 0.80, 7.2, 5.0),
    ("highland", 0.18, 0.80, 0.70, 12.0, 0.80, 6.8, 4.6),
]
# Fixed value: climate of a site without one
DEFAULT_CLIMATE = "inland"
# Dust-loading factor by training region, target mean loss by region
REGION_FACTOR = [
    ("west", 0.55), ("east", 1.10), ("central", 0.60), ("north", 0.55),
    ("northwest", 0.45), ("southwest_highland", 0.30), ("unknown", 0.50),
]
REGION_TARGET_LOSS = [
    ("west", 15.0), ("east", 45.0), ("central", 28.0), ("north", 24.0),
    ("northwest", 23.0), ("southwest_highland", 14.0),
]
UNKNOWN_FACTOR = 0.50
UNKNOWN_TARGET_LOSS = 25.0

# economics
TARIFF_SAR_PER_KWH = 0.18
CLEANING_PRESETS = [("dry_saudi", 1800.0), ("robotic", 600.0), ("manual_iea", 5100.0)]
CLEANING_COST_SAR_PER_MWP = 1800.0
WET_CLEANING_MULTIPLIER = 1.45
WATER_LITRES_PER_MWP = 2500.0
DEFAULT_CLEANING_INTERVAL = 10
DEFAULT_THRESHOLD_PCT = 6.0

# Policy candidates
INTERVAL_CANDIDATES = (5, 7, 10, 14, 21, 30, 45, 60)
THRESHOLD_CANDIDATES = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0)

# Exposure model
REFERENCE_PM10 = 120.0
RAIN_WASHOFF_MM = 5.0
RAIN_WASHOFF_KEEP = 0.15
MAX_LOSS_FRAC = 0.55
MAX_EXPOSURE = 400.0
EXPOSURE_PR = 0.80
EXPOSURE_TEMP_COEFF = -0.0040

# Feature and label model
STORM_FLOOR = 300.0
STORM_MULT = 3.0
LABEL_PR = 0.80
LABEL_TEMP_COEFF = -0.0038
NOCT_C = 45.0
MASS_SCALE = 30.0
DAYS_SINCE_CAP = 120
WARMUP_ROWS = 45
HORIZON_ROWS = 3

# Mass-balance model
BALANCE_INTERVAL = 7
CLEAN_EFFICIENCY = 0.95
RAIN_RESET_MM = 5.0
PARTIAL_RAIN_MM = 0.5
ALPHA_RAIN = 0.35
RESUSPEND_KMH = 45.0
RESUSPEND_SLOPE = 0.011
V_SCALE = 0.080
P_EXP = 1.15
WIND_PEAK_MS = 5.5
WIND_SIGMA = 0.85
WIND_FLOOR = 0.25
K_LOSS = 0.81
CEMENT_BETA = 0.35
CEMENT_RH_REF = 40.0

# Batch economics
BATCH_COST_SAR_PER_KWP = 1.00
BATCH_YIELD_KWH_PER_KWP = 5.5
BATCH_INTERVAL = 7

# Feature order
FEATURES = [
    "lat", "lon", "elevation_m",
    "doy_sin", "doy_cos",
    "tmax_c", "tmin_c", "tmean_c", "rh_mean_pct",
    "wind_max_ms", "gust_max_ms", "precip_mm", "wind_dir_deg",
    "ghi_mj_m2",
    "pm10_max", "pm10_mean", "dust_max", "dust_mean", "aod_mean", "pm25_mean",
    "days_since_rain", "days_since_storm",
    "pm10_max_3d", "pm10_max_7d", "pm10_max_30d",
    "dust_mean_7d", "dust_mean_30d",
    "gust_max_7d", "gust_max_30d",
    "precip_7d", "precip_30d",
    "pm10_max_lag1", "pm10_max_lag2", "pm10_max_lag3",
    "dust_mean_lag1", "aod_mean_7d",
    "dust_factor_today",
]

# Accepted input name -> canonical column
ALIASES = {
    "latitude": "lat", "longitude": "lon", "elevation": "elevation_m", "elev": "elevation_m",
    "temperature": "tmean_c", "temp": "tmean_c", "temp_mean": "tmean_c", "t2m": "tmean_c",
    "temperature_2m": "tmean_c", "temperature_2c": "tmean_c", "air_temp": "tmean_c",
    "tmax": "tmax_c", "temperature_max": "tmax_c", "tmin": "tmin_c", "temperature_min": "tmin_c",
    "humidity": "rh_mean_pct", "rh": "rh_mean_pct", "relative_humidity": "rh_mean_pct",
    "relative_humidity_2m": "rh_mean_pct", "rh2m": "rh_mean_pct",
    "wind": "wind_max_kmh", "wind_speed": "wind_max_kmh", "wind_max": "wind_max_kmh",
    "windspeed_10m_max": "wind_max_kmh", "wind_speed_10m_max": "wind_max_kmh",
    "gust": "gust_max_kmh", "gusts": "gust_max_kmh", "wind_gusts_10m_max": "gust_max_kmh",
    "gusts_max_kmh": "gust_max_kmh",
    "precip": "precip_mm", "rain": "precip_mm", "precipitation": "precip_mm", "precipitation_sum": "precip_mm",
    "radiation": "radiation_mj_m2", "shortwave_radiation_sum": "radiation_mj_m2", "ghi": "radiation_mj_m2",
    "et0": "et0_mm", "evapotranspiration": "et0_mm",
    "pm10": "pm10_mean_ugm3", "pm10_mean": "pm10_mean_ugm3",
    "pm25": "pm2_5_mean_ugm3", "pm2_5": "pm2_5_mean_ugm3", "pm2.5": "pm2_5_mean_ugm3",
    "dust": "dust_mean_ugm3", "dust_concentration": "dust_mean_ugm3",
    "aod": "aod_mean", "aerosol_optical_depth": "aod_mean", "aerosol_optical_depth_mean": "aod_mean",
    "days_since_rain": "days_since_rain", "days_since_clean": "days_since_clean",
    "day_of_year": "doy", "doy": "doy", "date": "date",
}
# Rolling columns which take the instantaneous value when absent
ROLL_SOURCES = {
    "pm10_mean_ugm3": ["pm10_mean_ugm3_3d_mean", "pm10_mean_ugm3_7d_mean",
                       "pm10_mean_ugm3_30d_mean", "pm10_mean_ugm3_90d_mean", "pm10_mean_ugm3_expmean"],
    "dust_mean_ugm3": ["dust_mean_ugm3_7d_mean", "dust_mean_ugm3_30d_mean", "dust_mean_ugm3_expmean"],
    "aod_mean": ["aod_mean_7d_mean", "aod_mean_expmean"],
    "wind_max_kmh": ["wind_max_kmh_7d_mean", "wind_max_kmh_30d_mean"],
    "gust_max_kmh": ["gust_max_kmh_7d_mean"],
    "rh_mean_pct": ["rh_mean_pct_7d_mean"],
    "precip_mm": ["precip_mm_7d_sum", "precip_mm_30d_sum"],
    "pm10_max_ugm3": ["pm10_max_ugm3_7d_max"],
}
# Rolling columns of the first-generation training table (column, rows, function)
TRAINING_ROLLS = [
    ("pm10_mean_ugm3", 3, "mean"), ("pm10_mean_ugm3", 7, "mean"),
    ("pm10_mean_ugm3", 30, "mean"), ("pm10_mean_ugm3", 90, "mean"),
    ("dust_mean_ugm3", 7, "mean"), ("dust_mean_ugm3", 30, "mean"),
    ("aod_mean", 7, "mean"),
    ("wind_max_kmh", 7, "mean"), ("wind_max_kmh", 30, "mean"),
    ("gust_max_kmh", 7, "mean"), ("rh_mean_pct", 7, "mean"),
    ("precip_mm", 7, "sum"), ("precip_mm", 30, "sum"),
    ("pm10_max_ugm3", 7, "max"),
]
TRAINING_EXPANDING = ["pm10_mean_ugm3", "dust_mean_ugm3", "aod_mean"]

# retrieval
BM25_K1 = 1.5
BM25_B = 0.75
CONTEXT_BUDGET = 4500
TURN_CHARS = 4000
TOKEN_PATTERN = r"[a-z0-9][a-z0-9.\-_%]*"
STOP_WORDS = (
    "a an the and or but if then than that this these those of in on at to for from with without by as "
    "is are was were be been being it its into over under about after before during between within not "
    "no nor so such only own same too very can will just should now also per via we our you your they "
    "their he she his her i me my more most some any each other another"
).split()

# Raster-layer catalogue
LAYER_KEYWORDS = ("aerosol", "aod", "dust", "maiac", "merra2", "pm25", "airs_l2_dust")
LAYERS_KEPT = (
    "MODIS_Terra_Aerosol",
    "MODIS_Aqua_Aerosol_Optical_Depth_3km",
    "MODIS_Combined_MAIAC_L2G_AerosolOpticalDepth",
    "MODIS_Terra_AOD_Deep_Blue_Land",
    "AIRS_L2_Dust_Score_Day",
    "MERRA2_Dust_Surface_Mass_Concentration_Monthly",
    "MERRA2_Total_Aerosol_Optical_Thickness_550nm_Extinction_Monthly",
    "MERRA2_Total_Dust_Deposition_Dry_Wet_Monthly",
    "MODIS_Terra_CorrectedReflectance_TrueColor",
)
EARTH_RADIUS_KM = 6371.0
