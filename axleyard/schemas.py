"""Tables of the fleet model and the fixed values that results depend on."""

from __future__ import annotations

TELEMATICS = "user_id long, asset_id long, record_date date, operating_hours double, idle_hours double, total_engine_hours double, odometer_km double, litres_consumed double"
FUEL_PURCHASES = "user_id long, vehicle_id long, purchase_date date, litres double, cost_nzd double, odometer_reading double, source string"
ASSETS = "asset_id long, user_id long, asset_name string, asset_type string, fuel_type string, bp_card_number string, mobil_card_number string, current_odometer double"
OEM_UPLOAD = "asset_name string, record_date date, total_engine_hours double, operating_hours double, idle_hours double, litres_consumed double, odometer_km double"
PENDING_ASSETS = "user_id long, asset_name string, asset_type string, registration string, source string, raw_data string"
CALIBRATION_INTERVALS = "asset_id long, interval_start_date date, interval_end_date date, distance_km double, litres double, idle_hours double, included boolean, exclusion_reason string"

# They must be these for the results to be right.
BP_FUEL_PRODUCTS = ["NZ Diesel", "NZ Ultimate Diesel", "NZ Ultimate", "NZ Premium Unleaded", "NZ Unleaded"]
MOBIL_FUEL_PRODUCTS = ["Diesel", "Mobil Diesel Efficient", "Synergy Diesel\\Extra Diesel", "Unleaded 91", "Premium Unleaded", "Synergy Extra Unleaded"]
ON_ROAD_TYPES = ["Light Vehicle", "Rigid Truck", "Semi Trailer"]
MIN_PRICE_PER_LITRE, MAX_PRICE_PER_LITRE = 0.50, 6.00
MAX_IDLE_HOURS, HIGH_IDLE_HOURS = 24.0, 10.0
MIN_INTERVALS_TO_CALIBRATE = 6
RATE_CHANGE_CAP = 0.30
IDLE_ANOMALY_CHANGE = 0.50
MIN_PLAUSIBLE_FILL_LITRES = 3.0
ODOMETER_SEARCH_DAYS = 3
MAX_GAP_RUN_DAYS = 3
MIN_GAP_RUN = 2
HOLIDAYS = ["2026-01-01", "2026-01-02", "2026-02-06", "2026-04-03", "2026-04-06", "2026-04-25", "2026-06-01", "2026-07-10"]
#: class: (prior, lowest, highest) litres an hour
IDLE_CLASSES = {"pto_heavy": (1.8, 1.2, 8.0), "light_vehicle": (1.0, 0.5, 2.0), "standard_truck": (2.0, 1.3, 4.5)}
POOLED_ROUNDS, POOLED_TOLERANCE = 10, 0.01
MIN_REMAINING_LIFE_HOURS, MIN_REMAINING_LIFE_KM, REMAINING_LIFE_SHARE = 5.0, 100.0, 0.02
APPROACHING_LIFE = 0.9
LIFE_EXCEEDED_MESSAGE = "Cannot calculate — asset has reached or exceeded its expected life. Update Expected Life Hours (or Expected Life KM) on the Assets page to continue tracking depreciation."
LIFE_NEAR_LIMIT_MESSAGE = "Cannot calculate — asset is within 2% of its expected life limit and the depreciation rate is no longer meaningful. Update Expected Life Hours (or Expected Life KM) on the Assets page to continue tracking depreciation."
DEFAULT_IDLE_RATES = {
    "Excavator": 4.0, "Dump Truck": 5.5, "Wheel Loader": 4.5, "Motor Grader": 4.0, "Bulldozer": 5.0, "Crane": 4.5,
    "Forklift": 1.5, "Light Vehicle": 1.2, "Rigid Truck": 2.5, "Semi Trailer": 3.0, "Water Truck": 3.5, "Other": 3.0,
}
OTHER_IDLE_RATE = 3.0
EMISSION_FACTORS = {"Diesel": 2.68, "Petrol": 2.31, "Electric": 0.0, "Hybrid": 1.5}
OTHER_EMISSION_FACTOR = 2.68
REPORT_EMISSION_FACTOR = 2.680680605
DEFAULT_HOURS_PER_WEEK = 40.0
PLATFORM_FEE, TRUCK_FEE, MACHINE_FEE, INVOICE_MIN_ASSETS = 49.0, 8.0, 15.0, 10
#: format: (columns that a header line must hold, lines to look at)
SIGNATURES = {
    "exec_summary": (["VehicleName", "TotalHours", "IdleTime"], 30),
    "bp_transaction": (["Transaction Effective Date", "Card Number", "Litres", "Customer Value ($)", "Vehicle Description"], 15),
    "bp": (["Transaction Effective Date", "Card Number", "Litres", "Customer Value ($)"], 30),
    "mobil": (["Transaction Date", "Card No.", "Quantity", "Total", "Product Description"], 15),
    "mileage": (["Vehicle", "ActivityDate", "ActualDistance"], 10),
    "idle": (["Vehicle", "IdleStart", "IdleEnd", "Duration"], 10),
}
MAIL_ORDER = ["exec_summary", "bp_transaction", "bp", "mobil", "mileage", "idle"]
BULK_ORDER = ["mileage", "idle", "exec_summary", "bp_transaction", "bp", "mobil"]
UNKNOWN_KEYWORDS = {
    "on_road_telematics": ["mileage", "odometer", "distance", "trip", "idle"],
    "fuel_provider": ["litres", "card number", "fuel", "customer value", "transaction"],
    "oem_machinery_telematics": ["productive", "idle fuel", "operating fuel", "engine hours", "machine"],
}
SEMI_WORDS = ["semi", "kenworth", "freightliner", "mack", "volvo", "scania", "man ", "daf", "prime mover", "b-train", "a-train"]
TRUCK_WORDS = ["hino", "isuzu", "fuso", "ud ", "rigid", "truck"]
LIGHT_WORDS = ["ranger", "hilux", "navara", "triton", "colorado", "d-max", "bt-50", "amarok", "ute", "suv", "sedan", "wagon", "van", "transit", "sprinter", "hiace"]
#: (type, words), tried in this order after the road vehicles
MACHINE_WORDS = [
    ("Bulldozer", ["bulldozer", "dozer"]), ("Excavator", ["excavator", "digger"]), ("Motor Grader", ["grader"]), ("Forklift", ["forklift"]),
    ("Crane", ["crane"]), ("Wheel Loader", ["loader"]), ("Other", ["roller", "scraper"]),
]
CSV_MIME = ["text/csv", "application/csv", "text/comma-separated-values"]
XLS_MIME = ["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]
