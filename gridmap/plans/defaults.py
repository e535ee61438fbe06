"""Default configuration: labels, sections, fields, header vocabulary, templates.

Everything a user would normally supply through configuration files lives
here as plain data, and is turned into small DataFrames by ``gridmap.plans.dims``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The document classes, in label order (order decides ties when
# several labels appear in one answer).  "None of those" ends processing.
# ---------------------------------------------------------------------------
CLASS_LABELS = [
    "Mutual Funds", "ETF", "Stocks", "Bonds", "Real State",
    "Crypto Asset", "Commodities", "Private Equities", "Index",
    "Currencies Pairs", "None of those",
]
NONE_LABEL = "None of those"

# Label spellings a scorer may use for a label (answer text -> label).
LABEL_SYNONYMS = {"Real Estate": "Real State"}

# ---------------------------------------------------------------------------
# Sections and fields of the "Mutual Funds" document type, in
# configuration order, each field with the header spellings seen in labelled
# price files (bracketed spellings such as "[EUR]" are values, not headers, and
# are left out).
# ---------------------------------------------------------------------------
FUND_SECTIONS = [
    ("Identifier", [
        ("Code", "string", ["USD.ISIN", "ISIN Code", "CodIsin", "ISIN CODE", "ISIN", "Sedol",
                            "Instrument Identifier/ISIN code", "WKN", "Code ISIN", "SEDOL", "ISIN code",
                            "Column2", "BloombergTicker", "VN", "FMSedols", "ISESedols", "EuroClearCedel",
                            "Bundesamt", "AFCCodes", "CODE_ISIN", "CODE_WPK", "CODE ISIN", "Isin Code"]),
        ("CodeType", "string", ["Isin", "Sedol", "Wertpapierkennnummer", "Bloomberg", "Valorennummer",
                                "Euroclear", "AssociationFrançaisedesCreditsCodes"]),
        ("Currency", "string", ["Share currency", "Divisa", "CURRENCY", "Curr", "Currency", "Devise", "Column7",
                                "PRICE CCY", "FV-Currency", "BASECurrency", "Dev", "Denomination", "devise"]),
        ("CIC Code", "string", []),
    ]),
    ("Denomination", [
        ("VehiculeName", "string", ["Fund Name", "Umbrella_Name"]),
        ("CompartmentName", "string", ["Sub Fund Name", "Fund Name", "COMPARTMENT", "TITLE"]),
        ("InstrumentName", "string", ["Fund Name and Class", "Descrizione", "FUND NAME", "Share Class Name",
                                      "Fund Name", "DISPLAY_NAME", "FONDS", "Libellé", "Name", "Fund name",
                                      "Column1", "Name of the Fund", "Fund_Name", "FCP", "NAME", "Nom"]),
        ("ShareType", "string", ["Share Name", "SHARE CLASSE", "Currency", "CLASS", "TITLE", "Fund_Class"]),
    ]),
    ("Valorisation", [
        ("Nav", "float", ["USD.Price", "NAV Date", "Quota", "NAV PRICE", "Unrounded NAV Price", "NAV per share",
                          "NAV", "VL", "Price", "Column4", "PRICE", "NAV_per_unit", "QUOTED PRICE",
                          "Valeur Liquidative", "NAV_Today", "Re-Invest Net Asset Value Per Share", "vl"]),
        ("NavDate", "date", ["Share Price", "Data Competenza:", "NAV DATE", "Price Date", "Datum", "Date",
                             "Column3", "DATE", "Date VL", "VAL DATE", "Evalution", "Valuation_Date",
                             "PRICE DATE", "Date de publication", "TRADEDATE", "Payable Date", "date"]),
    ]),
    ("MarketCap", [
        ("ReferenceDate", "date", ["Price Date", "Date VL"]),
        ("CompartmentCurrency", "string", ["Sub Fund Currency", "Total_NAV_per_Class_Base_Ccy"]),
        ("CompartmentAssetValue", "float", ["TNA VALUE", "Base CCY Share Class NAV", "Total NAV", "Actif Part",
                                            "Total net assets value", "Column6", "Encours_Global",
                                            "Total_Net_Assets_per_Class_MIL", "FUND NAME", "Actif Net",
                                            "TOTAL_NAV", "actif"]),
        ("ShareAssetValue", "float", ["Net asset Value", "Nb Parts", "Encours Net"]),
        ("Number of Shares", "float", ["Number of Shares", "UNITS OUTSTANDING", "Share Class Units In Issue",
                                       "Shares Outstanding", "Shares outstanding per shareclass",
                                       "Number of shares", "Column5", "Nb Parts", "UNITS IN ISSUE",
                                       "Number-of-shares-Tranche", "Units_In_Issue", "Nombre de Parts",
                                       "SHARES_OUTSTANDING", "parts"]),
    ]),
    ("CorporateAction", [
        ("Currency", "string", ["Dividend Currency", "Currency", "Devise", "EUR"]),
        ("Type", "string", ["Dividend", "Coupon", "Split"]),
        ("Value", "float", ["Dividend Value-Date", "COUPON", "Div Value", "Price Date", "Distribution"]),
        ("ExecutionDate", "date", ["Dividend Ex-Date", "DATE", "Ex Div Date", "Distribution start date",
                                   "Date VL", "Distribution-Date", "Split-date", "Ex Date"]),
        ("PaymentDate", "date", ["Div Pay Date", "Distribution end date", "Payable Date"]),
        ("RecordDate", "date", ["Record Date"]),
        ("Percentage", "float", []),
        ("DistributionRate", "float", ["Dividend per Share", "Distribution ratio", "Distribution Ratio (%)",
                                       "Per Share Rate"]),
        ("SplitFactor", "float", ["Split-Factor"]),
    ]),
    ("Characteristics", [
        ("Strategy", "string", []),
        ("AssetManager", "string", []),
        ("PortfolioManager", "string", []),
        ("HostingCountry", "string", []),
        ("LegalStatus", "string", []),
        ("UnderLegalStatus", "string", []),
        ("InceptionDate", "date", []),
        ("DistributionPolicy", "string", []),
        ("PaymentFrequency", "string", []),
        ("LiquidationDate", "date", ["Liquidation-Date"]),
    ]),
]

# Class -> sections.  Only classes with a configuration can be mapped; the
# rest end in CONFIG_FILE_NOT_FOUND.
CLASS_CONFIGS = {"Mutual Funds": FUND_SECTIONS}

# Keywords of the deterministic class scorer (lower-case tokens, weight).
CLASS_TERMS = {
    "Mutual Funds": [("fund", 2), ("funds", 2), ("fonds", 2), ("nav", 2), ("vl", 1), ("isin", 1),
                     ("sicav", 2), ("oeic", 2), ("ucits", 2), ("fcp", 2), ("quota", 1)],
    "ETF": [("etf", 3), ("etfs", 3), ("tracker", 2)],
    "Stocks": [("stock", 2), ("stocks", 2), ("equity", 1), ("equities", 1), ("shares", 1), ("ticker", 1)],
    "Bonds": [("bond", 2), ("bonds", 2), ("coupon", 2), ("maturity", 2), ("yield", 1)],
    "Real State": [("estate", 2), ("property", 2), ("reit", 3)],
    "Crypto Asset": [("crypto", 3), ("bitcoin", 3), ("token", 1), ("blockchain", 2)],
    "Commodities": [("commodity", 3), ("commodities", 3), ("gold", 2), ("oil", 2)],
    "Private Equities": [("private", 2), ("buyout", 2), ("venture", 2)],
    "Index": [("index", 3), ("indices", 3), ("benchmark", 1)],
    "Currencies Pairs": [("fx", 2), ("forex", 3), ("eurusd", 3), ("usdjpy", 3), ("exchange", 1)],
}

# Default confidences used when a stage gives none.
HEADER_CONFIDENCE_THRESHOLD = 0.7
CONF_EXTRACTED_ONLY = 0.5
CONF_NOT_EXTRACTED = 0.0
CONF_NOT_SCORED = 0.9

# Rows that the row window operator shows; jobs read whole sheets unless told otherwise.
START_ROW, END_ROW = 0, 15
# Prompt budget of the class scorer: max_tokens * share, 4 characters per token.
CLASS_MAX_TOKENS, CLASS_CONTEXT_PCT = 4000, 0.45
# Content rows shown after the header when extracting sections.
FOCUS_CONTENT_ROWS = 10

# Our own prompt templates (placeholders are filled by plain replacement).
CLASS_PROMPT = (
    "Classify the financial document below into one asset class.\n"
    "Document name: {doc_name}\n"
    "Beginning of the document:\n{question}\n"
    "Answer as <class>label</class><confidence>High|Medium|Low</confidence>."
)
CLASS_VALIDATION_PROMPT = (
    "A previous step classified the document as {previous_class}.\n"
    "Document name: {doc_name}\n"
    "Beginning of the document:\n{text}\n"
    "Check the class. Answer as <class>label</class><confidence>High|Medium|Low</confidence>"
    "<reason>one or two sentences</reason>."
)
DEFAULT_SYSTEM_MESSAGE = "You are a helpful assistant."
CORRECTION_TEXT = "Corrected capitalization and removed non-header values."
TOOL_OUTPUT_TEXT = "You have correctly called this tool."
