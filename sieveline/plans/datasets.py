"""The dataset specs.

The column → concept maps, exclusion lists, vocabularies, thresholds and filters
below are fixed values: they define the datasets and must be as published.
"""

from __future__ import annotations

from sieveline.plans.specs import DatasetSpec

# --- fixed values: small datasets ---------------------------------------------------

CARS = DatasetSpec(
    datapred="cars/price",
    task="regression",
    label="Selling_Price",
    derive={"Age": "2023 - Year"},
    concepts={
        "Present_Price": "Present price",
        "Driven_kms": "Driven kilometers",
        "Fuel_Type": "Fuel type",
        "Selling_type": "Selling type (dealer/individual)",
        "Transmission": "Transmission (manual/automatic)",
        "Owner": "Number of previous owners",
        "Age": "Age",
    },
    numeric=("Present price", "Driven kilometers", "Number of previous owners", "Age"),
)

PIMA = DatasetSpec(
    datapred="pima/diabetes",
    task="classification",
    label="Outcome",
    concepts={
        "Pregnancies": "Number of times pregnant",
        "Glucose": "Plasma glucose concentration at 2 hours in an oral glucose tolerance test",
        "BloodPressure": "Diastolic blood pressure (mmHg)",
        "SkinThickness": "Triceps skin fold thickness (mm)",
        "Insulin": "2-hour serum insulin (muU/ml)",
        "BMI": "Body mass index (weight in kg/(height in m)^2)",
        "DiabetesPedigreeFunction": "Diabetes pedigree function",
        "Age": "Age",
    },
)

GIVE_ME_CREDIT = DatasetSpec(
    datapred="give-me-credit/delinquency",
    task="classification",
    label="SeriousDlqin2yrs",
    drop_missing=True,
    concepts={
        "RevolvingUtilizationOfUnsecuredLines": "Total balance on credit cards and personal lines of credit "
        "(except real estate and no installment debt like car loans, divided by monthly gross income)",
        "age": "Age",
        "DebtRatio": "Monthly debt payments, alimony, and living costs, divided by monthly gross income",
        "MonthlyIncome": "Monthly income",
        "NumberOfOpenCreditLinesAndLoans": "Number of open loans and lines of credit",
        "NumberRealEstateLoansOrLines":
            "Number of mortgage and real estate loans, including home equity lines of credit",
        "NumberOfTime30-59DaysPastDueNotWorse": "Number of times borrower has been 30 to 59 days past due "
        "(but no worse) in the last 2 years",
        "NumberOfTime60-89DaysPastDueNotWorse": "Number of times borrower has been 60 to 89 days past due "
        "(but no worse) in the last 2 years",
        "NumberOfTimes90DaysLate": "Number of times borrower has been 90 days or more past due in the last 2 years",
        "NumberOfDependents": "Number of dependents in family, excluding themselves",
    },
)

#: Optional trim of give-me-credit: rows above these quantiles are outliers.
GIVE_ME_CREDIT_TRIM = {
    "NumberOfTime30-59DaysPastDueNotWorse": 0.95,
    "DebtRatio": 0.95,
    "MonthlyIncome": 0.95,
    "RevolvingUtilizationOfUnsecuredLines": 0.998,
    "NumberOfTimes90DaysLate": 0.998,
    "NumberRealEstateLoansOrLines": 0.998,
    "NumberOfTime60-89DaysPastDueNotWorse": 0.998,
    "NumberOfDependents": 0.998,
}

COMPAS = DatasetSpec(
    datapred="compas/recid",
    task="classification",
    label="score_text IS DISTINCT FROM 'Low'",
    where=(
        # a missing value is unequal to every value, but no range holds it
        "days_b_screening_arrest <= 30 AND days_b_screening_arrest >= -30 AND is_recid IS DISTINCT FROM -1 "
        "AND c_charge_degree IS DISTINCT FROM 'O' AND score_text IS DISTINCT FROM 'N/A'"
    ),
    derive={
        "c_jail_los": "CAST(floor((unix_timestamp(c_jail_out) - unix_timestamp(c_jail_in)) / 86400D) AS BIGINT)",
        "c_jail_in_year": "year(c_jail_in)",
        "c_jail_out_year": "year(c_jail_out)",
        "dob_year": "year(dob)",
    },
    concepts={
        "sex": "Sex",
        "age": "Age",
        "age_cat": "Age Group (<25, 25-45, >45)",
        "race": "Race",
        "juv_fel_count": "Juvenile Felony Count",
        "juv_misd_count": "Juvenile Misdemeanor Count",
        "juv_other_count": "Juvenile Other Count (Not Felony or Misdemeanor)",
        "priors_count": "Number of Prior Criminal Offenses",
        "c_charge_degree": "Charge Degree (Felony or Misdemeanor)",
        "two_year_recid": "Recidivism within Two Years After Release (Yes/No)",
        "c_jail_los": "Length of Stay in Jail",
        "c_jail_in_year": "Year Sent to Jail",
        "c_jail_out_year": "Year Out of Jail",
        "dob_year": "Year of Birth",
    },
    numeric=(
        "Age",
        "Juvenile Felony Count",
        "Juvenile Misdemeanor Count",
        "Juvenile Other Count (Not Felony or Misdemeanor)",
        "Number of Prior Criminal Offenses",
        "Recidivism within Two Years After Release (Yes/No)",
        "Length of Stay in Jail",
        "Year Sent to Jail",
        "Year Out of Jail",
        "Year of Birth",
    ),
)

MIAMI_HOUSING = DatasetSpec(
    datapred="miami-housing/price",
    task="regression",
    label="ln(SALE_PRC)",
    concepts={
        "LND_SQFOOT": "land area (square feet)",
        "TOT_LVG_AREA": "floor area (square feet)",
        "SPEC_FEAT_VAL": "value of special features (e.g., swimming pools)",
        "RAIL_DIST": "distance to the nearest rail line (an indicator of noise) (feet)",
        "OCEAN_DIST": "distance to the ocean (feet)",
        "WATER_DIST": "distance to the nearest body of water (feet)",
        "CNTR_DIST": "distance to the Miami central business district (feet)",
        "SUBCNTR_DI": "distance to the nearest subcenter (feet)",
        "HWY_DIST": "distance to the nearest highway (an indicator of noise) (feet)",
        "age": "age of the structure",
        "avno60plus": "dummy variable for airplane noise exceeding an acceptable level",
        "structure_quality": "quality of the structure",
        "month_sold": "sale month in 2016 (1 = january)",
        "LATITUDE": "latitude",
        "LONGITUDE": "longitude",
    },
)

_CELL_MEASURES = {
    "radius": "Radius",
    "texture": "Texture (SE in Gray-Scale Values)",
    "perimeter": "Perimeter",
    "area": "Area",
    "smoothness": "Smoothness (Local Variation in Radius Lengths)",
    "compactness": "Compactness (Perimeter^2 / Area - 1)",
    "concavity": "Concavity (Severity of Concave Portions of the Contour)",
    "concave points": "Concave Points (Number of Concave Portions of the Contour)",
    "symmetry": "Symmetry",
    "fractal dimension": 'Fractal Dimension ("Coastline Approximation" - 1)',
}

BREAST_CANCER = DatasetSpec(
    datapred="breast-cancer/diagnosis",
    task="classification",
    label="target",
    concepts={
        **{f"mean {k}": f"Mean {v}" for k, v in _CELL_MEASURES.items()},
        **{f"{k} error": f"SE in {v}" for k, v in _CELL_MEASURES.items()},
        **{f"worst {k}": f"Worst {v}" for k, v in _CELL_MEASURES.items()},
    },
)

WINE = DatasetSpec(
    datapred="wine/quality",
    task="regression",
    label="quality",
    concepts={
        "fixed acidity": "Fixed acidity (g(tartaric acid)/dm^3)",
        "volatile acidity": "Volatile acidity (g(acetic acid)/dm^3)",
        "citric acid": "Citric acid (g/dm^3)",
        "residual sugar": "Residual sugar (g/dm^3)",
        "chlorides": "Chlorides (g(sodium chloride)/dm^3)",
        "free sulfur dioxide": "Free sulfur dioxide (mg/dm^3)",
        "total sulfur dioxide": "Total sulfur dioxide (mg/dm^3)",
        "density": "Density (g/cm^3)",
        "pH": "pH",
        "sulphates": "Sulphates (g(potassium sulphate)/dm^3)",
        "alcohol": "Alcohol (vol.%)",
    },
)

CREDIT_G = DatasetSpec(
    datapred="credit-g/risk",
    task="classification",
    label="class = 'good'",
    concepts={
        "checking_status": "Status of existing checking account",
        "duration": "Duration, in months",
        "credit_history": "Credit history (credits taken, paid back duly, delays, critical accounts)",
        "purpose": "Purpose of the credit (e.g., car, television, education)",
        "credit_amount": "Credit amount",
        "savings_status": "Status of savings accounts/bonds, in Deutsche Mark",
        "employment": "Number of years spent in current employment",
        "installment_commitment": "Installment rate in percentage of disposable income",
        "personal_status": "Sex and marital status",
        "other_parties": "Other debtors/guarantors (none/co-applicant/guarantor)",
        "residence_since": "Number of years spent in current residence",
        "property_magnitude": "Property (e.g., real estate, life insurance)",
        "age": "Age",
        "other_payment_plans": "Other installment plans (bank/stores/none)",
        "housing": "Housing (rent/own/for free)",
        "existing_credits": "Number of existing credits at the bank",
        "job": "Job",
        "num_dependents": "Number of people being liable to provide maintenance for",
        "own_telephone": "Telephone (none/registered under customer's name)",
        "foreign_worker": "Is a foreign worker (yes/no)",
    },
)

DIABETES = DatasetSpec(
    datapred="diabetes/progression",
    task="regression",
    label="target",
    concepts={
        "age": "Age",
        "sex": "Sex",
        "bmi": "Body Mass Index (BMI)",
        "bp": "Average Blood Pressure",
        "s1": "Total Serum Cholesterol (TC)",
        "s2": "Low-Density Lipoproteins (LDL)",
        "s3": "High-Density Lipoproteins (HDL)",
        "s4": "Total Cholesterol / HDL (TCH)",
        "s5": "Log of Serum Triglycerides Level (LTG)",
        "s6": "Blood Sugar Level",
    },
)

CALHOUSING = DatasetSpec(
    datapred="calhousing/price",
    task="regression",
    label="target",
    concepts={
        "MedInc": "Median Income in U.S. Census Block Group",
        "HouseAge": "Median House Age in U.S. Census Block Group",
        "AveRooms": "Average Number of Rooms Per Household",
        "AveBedrms": "Average Number of Bedrooms Per Household",
        "Population": "U.S. Census Block Group Population",
        "AveOccup": "Average Number of Household Members",
        "Latitude": "Latitude of U.S. Census Block Group",
        "Longitude": "Longitude of U.S. Census Block Group",
    },
)

_BANK_CONCEPTS = (
    "Age",
    "Occupation",
    "Marital Status",
    "Education Level",
    "Has Credit in Default",
    "Average Yearly Account Balance",
    "Has Housing Loan",
    "Has Personal Loan",
    "Contact Communication Type (e.g. Cellular, Telephone)",
    "Last Contact Day of Month",
    "Last Contact Month of Year",
    "Last Contact Duration (in Seconds)",
    "Number of Contacts Performed During This Campaign and for This Client",
    "Number of Days Passed After the Client was Last Contacted from a Previous Campaign",
    "Number of Contacts Performed Before This Campaign and for This Client",
    "Outcome of the Previous Marketing Campaign",
)

BANK = DatasetSpec(
    datapred="bank/subscription",
    task="classification",
    label="Class = '2'",
    concepts={f"V{i + 1}": c for i, c in enumerate(_BANK_CONCEPTS)},
)

SMALL = [CREDIT_G, BANK, GIVE_ME_CREDIT, COMPAS, PIMA, CALHOUSING, DIABETES, WINE, MIAMI_HOUSING, CARS, BREAST_CANCER]

# --- fixed values: census survey tasks -------------------------------------------------

_SURVEY_ALWAYS = ["RT", "SERIALNO", "NAICSP", "SOCP"]

SURVEY_EXCLUDED = {
    "income": _SURVEY_ALWAYS + """
        PINCP ADJINC FINCP HINCP FFINCP FHINCP HINS1 HINS2 HINS3 HINS4 HINS5 HINS6 HINS7 INTP OIP PAP RETP
        SEMP SSIP SSP WAGP HICOV PERNP POVPIP PRIVCOV PUBCOV FHICOVP FHINS1P FHINS2P FHINS3C FHINS3P FHINS4C
        FHINS4P FHINS5C FHINS5P FHINS6P FHINS7P FINTP FOIP FPAP FPINCP FPRIVCOVP FPUBCOVP FRETP FSEMP FSSIP
        FSSP FWAGP GRPIP OCPIP""".split(),
    "employment": _SURVEY_ALWAYS + """
        ESR FES NWAB NWAV NWLA NWLK NWRE SEMP FESRP FSEMP FWRKP FWKWP FWKLP FWKHP POWSP POWPUMA OCCP JWDP
        JWAP WRK WKW WKL WKHP WAGP SSP SSIP WORKSTAT FRETP FJWTRP FOCCP FPOWSP FCOWP FJWDP FJWMNP SOCP RETP
        JWTR JWMNP COW WKEXREL WIF INDP PERNP DRIVESP JWRIP PINCP""".split(),
    "public_coverage": _SURVEY_ALWAYS + """
        PUBCOV ADJINC FINCP GRPIP HINCP OCPIP FFINCP FHINCP HINS1 HINS2 HINS3 HINS4 HINS5 HINS6 HINS7 INTP
        OIP PAP RETP SEMP SSIP SSP WAGP HICOV PERNP POVPIP PRIVCOV FHICOVP FHINS1P FHINS2P FHINS3C FHINS3P
        FHINS4C FHINS4P FHINS5C FHINS5P FHINS6P FHINS7P FINTP FOIP FPAP FPINCP FPRIVCOVP FPUBCOVP FRETP
        FSEMP FSSIP FSSP FWAGP""".split(),
    "mobility": _SURVEY_ALWAYS + "MIG FMIGP MIGPUMA MIGSP FMIGSP".split(),
}

SURVEY_LABEL = {
    "income": "PINCP > 50000",
    "employment": "ESR = 1",
    "public_coverage": "PUBCOV = 1",
    "mobility": "MIG = 1",
}

SURVEY_FILTER = {
    "income": "AGEP > 16 AND PINCP > 100 AND WKHP > 0 AND PWGTP >= 1",
    "employment": "AGEP > 16 AND AGEP < 90 AND PWGTP >= 1",
    "public_coverage": "AGEP < 65 AND PINCP <= 30000",
    "mobility": "AGEP > 18 AND AGEP < 35",
}

SURVEY_GROUP = "RAC1P"


def survey_spec(task: str, columns: list[str], names: dict[str, str] | None = None, eval_parity: bool = False) -> DatasetSpec:
    """Spec of one survey task over the columns at hand.

    Concepts are all columns that the task does not exclude; ``names`` maps a
    code to its display name.  ``eval_parity`` also leaves out the group column.
    """
    excluded = set(SURVEY_EXCLUDED[task]) | ({SURVEY_GROUP} if eval_parity else set())
    kept = [c for c in columns if c not in excluded]
    return DatasetSpec(
        datapred=f"acs/{task}",
        task="classification",
        label=f"coalesce({SURVEY_LABEL[task]}, false)",
        where=SURVEY_FILTER[task],
        group=SURVEY_GROUP,
        fill_missing=True,
        concepts={c: (names or {}).get(c, c) for c in kept},
    )


# --- fixed values: clinical vocabularies --------------------------------------------------

SERIES_VOCABULARY = {
    "capillary refill": ["abnormal", "normal"],
    "left dorsalis pedis pulse": ["absent", "faint", "doppler", "strong"],
    "right dorsalis pedis pulse": ["absent", "faint", "doppler", "strong"],
    "left radial pulse": ["absent", "faint", "doppler", "strong"],
    "right radial pulse": ["absent", "faint", "doppler", "strong"],
    "LLE strength / sensation": ["absent", "impaired", "intact"],
    "LUE strength / sensation": ["absent", "impaired", "intact"],
    "RLE strength / sensation": ["absent", "impaired", "intact"],
    "RUE strength / sensation": ["absent", "impaired", "intact"],
    "speech": ["aphasic", "garbled", "intubated", "mute", "other", "normal", "slurred", "dysphasic", "dysarthric"],
    "cough / gag reflex": ["absent", "impaired", "intact"],
    "Braden activity scale": ["1: bedfast", "2: chairfast", "3: walks occasionally", "4: walks frequently"],
    "Braden friction & shear scale": ["1: problem", "2: potential problem", "3: no apparent problem"],
    "Braden mobility scale": [
        "1: completely immobile", "2: very limited", "3: slightly limited", "4: no limitations"],
    "Braden moisture scale": ["1: consistently moist", "2: moist", "3: occasionally moist", "4: rarely moist"],
    "Braden nutrition scale": ["1: very poor", "2: probably inadequate", "3: adequate", "4: excellent"],
    "Braden sensory perception scale": [
        "1: completely limited", "2: very limited", "3: slightly limited", "4: no impairment"],
    "Morse ambulatory aid": [
        "bedrest", "cane", "crutches", "furniture", "none", "nurse assist", "walker", "wheel chair"],
    "Morse gait / transferring": ["weak", "normal", "bedrest", "immobile", "impaired"],
    "Morse history of falling": ["yes", "no"],
    "Morse mental status": ["forgets limitations", "oriented to own ability"],
    "Morse secondary diagnosis": ["yes", "no"],
    "delirium assessment": ["yes", "no"],
    "Glasgow coma scale (GCS) - Eye": ["1", "2", "3", "4"],
    "Glasgow coma scale (GCS) - Verbal": ["1", "2", "3", "4", "5"],
    "Glasgow coma scale (GCS) - Motor": ["1", "2", "3", "4", "5", "6"],
    "level of assistance": [
        "supervision", "total assist", "maximal assist", "moderate assist", "minimal assist", "independent"],
}

STATIC_VOCABULARY = {
    "gender": ["Female", "Male", "Other/Unknown"],
    "ethnicity": ["Asian", "Black", "Hispanic", "Native American", "Other/Unknown", "White"],
    "ICU unit type": [
        "Cardiac Intensive Care Unit (CICU)",
        "Cardiac Vascular Intensive Care Unit (CVICU)",
        "Cardiothoracic Intensive Care Unit (CTICU)",
        "Cardiac Care Unit/Cardiothoracic Intensive Care Unit (CCU/CTICU)",
        "Coronary Care Unit (CCU)",
        "Medical Intensive Care Unit (MICU)",
        "Medical/Surgical Intensive Care Unit (MICU/SICU)",
        "Neuro Intensive Care Unit (Neuro ICU)",
        "Neuro Intermediate",
        "Neuro Stepdown",
        "Neuro Surgical Intensive Care Unit (Neuro SICU)",
        "Surgical Intensive Care Unit (SICU)",
        "Trauma SICU (TSICU)",
        "Cardiac Surgical Intensive Care Unit (CSICU)",
    ],
}

STATIC_NUMERIC = ["age", "height", "weight"]
STATIC_CONCEPTS = [*STATIC_NUMERIC, "gender", "ethnicity", "ICU unit type"]
CLINICAL_TASKS = ["hf", "ckd", "copd"]
CLINICAL_HOURS, CLINICAL_BIN_HOURS = 24, 4

# --- fixed values: task and display names ---------------------------------------------------

TASK_OF = {
    **{s.datapred: s.task for s in SMALL},
    **{f"acs/{t}": "classification" for t in SURVEY_LABEL},
    **{f"mimic-icd/{t}": "classification" for t in CLINICAL_TASKS},
}

MODEL_NAMES = {
    "gpt-4-0613": "GPT-4 (1.7T)",
    "gpt-3.5-turbo": "GPT-3.5 (175B)",
    "llama-2-70b-chat": "Llama-2 (70B)",
    "llama-2-13b-chat": "Llama-2 (13B)",
    "llama-2-7b-chat": "Llama-2 (7B)",
}
MODEL_INDEX = {m: 4 - i for i, m in enumerate(MODEL_NAMES)}

_PROMPT_PARTS = {
    ":": "Default",
    ":examples": "Examples",
    ":expls": "Examples with CoT",
    "context:": "Context",
    "context:examples": "Context + Examples",
    "context:expls": "Context + Examples with CoT",
}
PROMPT_NAMES = {
    "greedy::": "T=0 (Default)*",
    **{f"greedy:{k}": f"T=0 ({v})" for k, v in _PROMPT_PARTS.items() if k != ":"},
    "consistent::": "T=0.5",
    **{f"consistent:{k}": f"T=0.5 ({v})" for k, v in _PROMPT_PARTS.items() if k != ":"},
}

SELECTION_NAMES = {
    "lassonet": "LassoNet",
    "lasso": "LASSO",
    "forward-seq": "Forward",
    "backward-seq": "Backward",
    "mrmr": "MRMR",
    "filter-mi": "Mutual Information",
    "rfe": "RFE",
    "random-concept": "Random",
}

IMPORTANCE_NAMES = {
    "range_1": "Score Range: [0,10]",
    "range_2": "Score Range: [8,24]",
    "rank": "LLM-Rank",
    "forward-seq": "LLM-Seq",
    "forward-seq-empty": "LLM-Seq",
    "shap-linear": "SHAP: Linear",
    "shap-xgb": "SHAP: XGBoost",
    "mi": "Mutual Information",
    "pearson": "Pearson",
    "spearman": "Spearman",
    "fisher": "Fisher Score",
    "perm": "Permutation",
    "random": "Random",
}

DATASET_NAMES = {
    "mimic-icd/hf": "HF",
    "mimic-icd/ckd": "CKD",
    "mimic-icd/copd": "COPD",
    "acs/employment": "Employment",
    "acs/income": "Income",
    "acs/mobility": "Mobility",
    "acs/public_coverage": "Public Coverage",
    "bank/subscription": "Bank",
    "calhousing/price": "CA Housing",
    "diabetes/progression": "Diabetes Progression",
    "credit-g/risk": "Credit-G",
    "wine/quality": "Wine Quality",
    "miami-housing/price": "Miami Housing",
    "compas/recid": "COMPAS Recidivism",
    "give-me-credit/delinquency": "Give Me Some Credit",
    "pima/diabetes": "Pima Indians Diabetes",
    "cars/price": "Used Cars",
}

#: Score ranges a score prompt may ask for.
SCORE_RANGES = [(0, 1), (0, 10), (8, 24)]
