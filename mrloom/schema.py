"""Fixed values of the header engine: field lists, tags, classes and sentinels."""

from __future__ import annotations

# Fields that a header must hold, and fields with defaults.
REQUIRED = ["StudyInstanceUID", "SeriesInstanceUID", "SeriesNumber", "ImageOrientationPatient", "PixelBandwidth", "EchoTime", "RepetitionTime", "FlipAngle", "PixelSpacing", "SliceThickness"]
OPTIONAL = ["SAR", "ImageType", "Manufacturer", "ContrastBolusAgent", "EchoNumbers", "EchoTrainLength", "ScanningSequence", "SequenceVariant", "InPlanePhaseEncodingDirection", "dBdt", "ImagingFrequency", "MRAcquisitionType", "NumberOfAverages", "InversionTime", "VariableFlipAngleFlag", "AcquisitionTime", "SeriesDescription"]

# What an absent optional field becomes. Numbers: NUMERIC; the rest: this text.
MISSING = -12345
NUMERIC = ["SAR", "EchoNumbers", "EchoTrainLength", "dBdt", "ImagingFrequency", "NumberOfAverages", "InversionTime"]
TEXT_DEFAULTS = {
    "Manufacturer": "UnknownManufacturer",
    "ImageType": "UnknownImageType",
    "ScanningSequence": "UnknownScanningSequence",
    "SequenceVariant": "UnknownSequenceVariant",
    "InPlanePhaseEncodingDirection": "UnknownInplanePhaseEncodingDirection",
    "MRAcquisitionType": "UnknownMRAcquisitionType",
    "VariableFlipAngleFlag": "UnknownVariableFlipAngleFlag",
    "SeriesDescription": "UnknownSeriesDescription",
}

# The features of the classifier, in the order of the vector.
FEATURES = ["Diffusionb-valueBool", "EchoTime", "EchoTrainLength", "FlipAngle", "HasDiffusionGradientOrientation", "ImageType_ADC", "ImageType_DERIVED", "ImageType_DIFFUSION", "ImageType_EADC", "ImageType_FA", "ImageType_ORIGINAL", "ImageType_TRACEW", "ImagingFrequency", "InversionTime", "Manufacturer_siemens", "NumberOfAverages", "PixelBandwidth", "RepetitionTime", "SAR", "ScanningSequence_GR", "ScanningSequence_IR", "ScanningSequence_SE", "SequenceVariant_MP", "SequenceVariant_SP", "dBdt", "has_b0", "has_pos_b0", "likely_diffusion"]

# Codes of the image types and of the planes.
IMAGE_TYPES = {"t1w": 0, "gret2star": 1, "t2w": 2, "flair": 3, "b0": 4, "tracew": 5, "adc": 6, "fa": 7, "eadc": 8, "dwig": 9}
PLANES = {"ax": 0, "cor": 1, "sag": 2}
DIFFUSION_TYPES = ["tracew", "adc", "fa", "eadc", "dwig"]

# Tags of the fields, as eight hexadecimal digits.
TAGS = {
    "SOPInstanceUID": "00080018",
    "StudyInstanceUID": "0020000D",
    "SeriesInstanceUID": "0020000E",
    "SeriesNumber": "00200011",
    "AcquisitionNumber": "00200012",
    "InstanceNumber": "00200013",
    "ImagePositionPatient": "00200032",
    "ImageOrientationPatient": "00200037",
    "Rows": "00280010",
    "Columns": "00280011",
    "PixelSpacing": "00280030",
    "PixelBandwidth": "00180095",
    "EchoTime": "00180081",
    "RepetitionTime": "00180080",
    "FlipAngle": "00181314",
    "SliceThickness": "00180050",
    "SAR": "00181316",
    "ImageType": "00080008",
    "Modality": "00080060",
    "Manufacturer": "00080070",
    "ContrastBolusAgent": "00180010",
    "EchoNumbers": "00180086",
    "EchoTrainLength": "00180091",
    "ScanningSequence": "00180020",
    "SequenceVariant": "00180021",
    "SequenceName": "00180024",
    "InPlanePhaseEncodingDirection": "00181312",
    "dBdt": "00181318",
    "ImagingFrequency": "00180084",
    "MRAcquisitionType": "00180023",
    "NumberOfAverages": "00180083",
    "InversionTime": "00180082",
    "VariableFlipAngleFlag": "00181315",
    "AcquisitionDate": "00080022",
    "AcquisitionTime": "00080032",
    "AcquisitionDateTime": "0008002A",
    "SeriesDescription": "0008103E",
}
# Tags that may hold the b-value and the gradient direction, in the order in which they are looked up.
B_VALUE_TAGS = ["00189087", "00431039", "20011003", "0019100C", "0019000C", "00651009"]
PACKED_B_VALUE_TAG, PACKED_B_VALUE_MODULUS, B_VALUE_LIMIT = "00431039", 100000, 5000
GRADIENT_TAGS = ["00189076", "001910E0", "20011004", "0019100E", "0019000E", "00651037"]
# Kinds of elements that no sheet holds.
UNSHEETED_KINDS = ["SQ", "OB", "OW", "OF", "UT", "UN"]
# Contrast agents that mean none.
NO_CONTRAST = ["none", "no", "no contrast", "no_contrast", "n", ""]
# Manufacturers of the buckets, in the order of the tests.
MANUFACTURERS = ["siemens", "ge", "philips", "toshiba"]

# Names of elements with personal or identifying content.
PERSONAL = [
    "Acquisition Date", "Acquisition Duration", "Acquisition Time", "Additional Patient History", "Admitting Diagnoses Description", "Allergies", "Anatomic Region Sequence",
    "Code Meaning", "Comments on the Performed Procedure Step", "Content Date", "Contributing Equipment Sequence", "Current Patient Location",
    "De-identification Method", "Device Serial Number", "Ethnic Group", "Heart Rate", "Image Comments", "Images in Acquisition", "Imaging Service Request Comments",
    "In-Stack Position Number", "Instance Creation Time", "Instance Creator UID", "Instance Number", "Institution Address", "Institution Name",
    "Institutional Department Name", "Issue Date of Imaging Service Request", "Issue Time of Imaging Service Request", "Lossy Image Compression", "Medical Alerts", "Military Rank",
    "Name of Physician(s) Reading Study", "Occupation", "Operators' Name", "Order Callback Phone Number", "Order Enterer's Location", "Other Patient IDs",
    "Patient Comments", "Patient ID", "Patient Identity Removed", "Patient Position", "Patient State", "Patient Transport Arrangements", "Patient's Address",
    "Patient's Age", "Patient's Birth Date", "Patient's Name", "Patient's Sex", "Patient's Size", "Patient's Telephone Numbers", "Patient's Weight",
    "Performed Location", "Performed Procedure Step End Date", "Performed Procedure Step End Time", "Performed Procedure Step Start Date", "Performed Procedure Step Start Time",
    "Performed Station AE Title", "Performed Station Name", "Performing Physician's Name", "Physician(s) of Record", "Pregnancy Status", "Procedure Code Sequence",
    "Reason for Study", "Reason for the Imaging Service Request", "Reason for the Requested Procedure", "Referenced SOP Instance UID", "Referring Physician's Name",
    "Requested Procedure Code Sequence", "Requested Procedure Description", "Requesting Physician Identification Sequence", "Requesting Physician", "SOP Instance UID",
    "Scheduled Performing Physician's Name", "Series Date", "Series Instance UID", "Series Number", "Series Time", "Slice Location", "Station Name", "Study Date", "Study ID",
    "Study Instance UID", "Study Time", "Temporal Position Identifier", "Timezone Offset From UTC", "Trigger Time", "Type of Patient ID", "Video Image Format Acquired",
    "Window Center & Width Explanation",
]
# Tags that stay when headers are de-identified (diffusion and contrast).
KEPT_TAGS = [
    "00189075", "00189076", "00189087", "00189089", "00189117", "00189147", "00189602", "00189603", "00189604", "00189605", "00189606", "00189607",
    "001910E0", "001910DF", "001910D9", "0021105A", "00431039", "0019100C", "0019100D", "0019100E", "00191027", "00291010",
    "0019000A", "0019000B", "0019000D", "0019000E", "0019000F", "00190027", "00190028", "20011003", "20011004", "200510B0", "200510B1", "200510B2",
    "00291001", "00291090", "00651009", "00651037", "00180010",
]
# Sheet columns that come first, if they are there.
FIRST_COLUMNS = [
    "FileName", "StudyInstanceUID", "SeriesInstanceUID", "PROSTAT_TYPE", "PROSTAT_TYPE_SeriesDescription", "SeriesDescription", "ImageTypeADC", "ImageTypeFA", "ImageTypeTrace",
    "ImageType", "ScanOptions", "SeriesNumber", "Manufacturer'sModelName", "ManufacturerCode", "HasDiffusionGradientOrientation", "Diffusionb-valueSet", "Diffusionb-valueCount",
    "Diffusionb-valueMax", "IsDerivedImageType", "AxialIndicator", "CoronalIndicator", "SaggitalIndicator", "ImageOrientationPatient_0", "ImageOrientationPatient_1",
    "ImageOrientationPatient_2", "ImageOrientationPatient_3", "ImageOrientationPatient_4", "ImageOrientationPatient_5", "SliceThickness",
]
# Fields whose equality makes two rows of a sheet duplicates.
DEDUPE_FIELDS = ["Echo Number(s)", "Echo Time", "Echo Train Length", "Flip Angle", "Image Type", "Imaging Frequency", "In-plane Phase Encoding Direction", "Inversion Time", "MR Acquisition Type", "Manufacturer", "Number of Averages", "Pixel Bandwidth", "Repetition Time", "SAR", "Scanning Sequence", "Sequence Variant", "Variable Flip Angle Flag", "dB/dt"]
NAME_LIMIT = 34
