"""Values that must match the published model's for results to agree."""

# Fuel production technologies and how they are reported.
# sector, subsector, technology, fuel, reporting_fuel, kgCO2_GJ, luc_fuel
FUEL_TECHS = (
    ("ammonia energy", "ammonia energy", "ammonia energy", "ammonia", "ammonia", 0.0, None),
    ("diesel", "biomass liquids", "FT biofuels", "FT biofuels", "FT biofuels", 0.0, "FT"),
    ("diesel", "biomass liquids", "FT biofuels CCS level 1", "FT biofuels CCS1", "FT biofuels CCS", 0.0, "FTCCS"),
    ("diesel", "biomass liquids", "FT biofuels CCS level 2", "FT biofuels CCS2", "FT biofuels CCS", 0.0, "FTCCS"),
    ("diesel", "biomass liquids", "renewable diesel", "renewable diesel", "renewable diesel", 0.0, "RD"),
    ("diesel", "e-fuels", "e-diesel", "e-diesel", "e-diesel", 0.0, None),
    ("diesel", "oil refining", "oil refining", "petroleum diesel", "petroleum diesel", 71.867, None),
    ("elect_td_trn", "elect_td_trn", "elect_td_trn", "electricity", "electricity", 0.0, None),
    ("H2 MHDV", "H2 delivery", "H2 liquid truck", "hydrogen from LH2truck", "hydrogen", 0.0, None),
    ("H2 MHDV", "H2 delivery", "H2 pipeline", "hydrogen from pipeline", "hydrogen", 0.0, None),
    ("H2 MHDV", "onsite production", "electrolysis", "hydrogen onsite electrolysis", "hydrogen", 0.0, None),
    ("H2 MHDV", "onsite production", "natural gas steam reforming", "hydrogen onsite smr", "hydrogen", 0.0, None),
    ("LH2", "H2 delivery", "H2 pipeline", "liquefied hydrogen", "liquefied hydrogen", 0.0, None),
    ("LNG", "LNG", "LNG", "LNG", "LNG", 52.1, None),
    ("methanol", "bio-methanol", "bio-methanol", "bio-methanol", "bio-methanol", 0.0, "methanol"),
    ("methanol", "e-methanol", "e-methanol", "e-methanol", "e-methanol", 0.0, None),
)

# Primary commodities, the fuel each is reported as, and kg CO2 per GJ.
CO2_FACTORS = (
    ("biomass", "Biomass", 0.0),
    ("carbon-storage", None, -3.667),
    ("distributed_solar", "Solar", 0.0),
    ("elec_geothermal", "Geothermal", 0.0),
    ("hydropower", "Hydropower", 0.0),
    ("global solar resource", "Solar", 0.0),
    ("nuclearFuelGenII", "Nuclear", 0.0),
    ("nuclearFuelGenIII", "Nuclear", 0.0),
    ("offshore wind resource", "Wind", 0.0),
    ("onshore wind resource", "Wind", 0.0),
    ("regional biomassOil", "Soybean oil", 0.0),
    ("regional coal", "Coal", 100.1),
    ("regional natural gas", "Natural Gas", 52.067),
    ("regional oil", "Oil", 71.867),
)

# 100-year global warming potentials.
GWP = (
    ("CH4", 30.0),
    ("H2", 12.0),
    ("N2O", 273.0),
)

# Production sector and the sector holding its delivered price.
DELIVERY_COST = (
    ("diesel", "delivered diesel"),
)

# Two-character scenario levels, their dimension and description.
SCENARIO_DEFINITIONS = (
    ("h1", "Hydrogen and Ammonia", "Default"),
    ("h2", "Hydrogen and Ammonia", "Green (Default cost)"),
    ("h3", "Hydrogen and Ammonia", "Green (Advanced cost)"),
    ("h4", "Hydrogen and Ammonia", "Blue"),
    ("r1", "Renewable Electricity", "Default"),
    ("r2", "Renewable Electricity", "Advanced cost"),
    ("r3", "Renewable Electricity", "Constrained"),
    ("b1", "Biomass Supply", "Default"),
    ("b2", "Biomass Supply", "Constrained"),
    ("n1", "Nuclear Electricity", "Default"),
    ("n2", "Nuclear Electricity", "Advanced cost"),
    ("c1", "CO2 Storage", "Default"),
    ("c2", "CO2 Storage", "Constrained"),
    ("p1", "Emissions Policy", "No policy"),
    ("p2", "Emissions Policy", "50 Percent by 2050"),
    ("p3", "Emissions Policy", "Net Zero by 2050"),
)

# Unit conversions, commodity and sector names, gas names.
USD_1975_TO_2020 = 3.8
USD_1990_TO_2020 = 1.772
CARBON_TO_CO2 = 44 / 12
NONCO2_GASES = ("CH4", "H2", "N2O")
EMITTED_GASES = ("CH4", "N2O", "N2O_AGR", "H2")
AGRICULTURAL_SUFFIX = "_AGR"
AGRICULTURAL_SUPPLY = "AgSupplySector"
WATER_WORD = "water"
OIL_CREDITS = "oil-credits"
HYDRO_TECHNOLOGY = "hydro"
HYDRO_COMMODITY = "hydropower"
STORAGE_COMMODITY = "carbon-storage"
CARBON_MARKET = "USACO2"
FREIGHT_SECTORS = ("trn_freight_road", "trn_freight", "trn_shipping_intl")
BASE_LUC_LEVEL = "base"

# Regions whose land-use change is counted.
LUC_REGIONS = (
    "USA", "Canada", "Africa_Eastern", "Africa_Northern", "Africa_Southern", "Africa_Western",
    "Japan", "South Korea", "China", "India", "Brazil", "Central America and Caribbean",
    "Central Asia", "EU-12", "EU-15", "Europe_Eastern", "Europe_Non_EU",
    "European Free Trade Association", "Indonesia", "Mexico", "Middle East", "Pakistan", "Russia",
    "South Africa", "South America_Northern", "South America_Southern", "South Asia",
    "Southeast Asia", "Taiwan", "Argentina", "Colombia", "Australia_NZ",
)
