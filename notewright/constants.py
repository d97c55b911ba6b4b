"""The instrument taxonomy, program names and text-format constants."""

from __future__ import annotations

# Time grid. One unit (U) is 1/8 beat, a bar is 4 beats, one TIME_DELTA step is 1/4 beat.
UNITS_PER_BEAT = 8
BEATS_PER_BAR = 4
UNITS_PER_BAR = UNITS_PER_BEAT * BEATS_PER_BAR
UNITS_PER_DELTA = 2
# The encoder's usual pitch range: the keys of a piano.
LOWEST_PITCH, HIGHEST_PITCH = 21, 108
MAX_DELTAS_PER_BAR = UNITS_PER_BAR // UNITS_PER_DELTA
BARS_PER_SECTION = 8
DEFAULT_VELOCITY = 99

# --- fixed values: instrument families, eight programs each, in program order ---
FAMILY_NAMES = [
    "Piano", "Chromatic Percussion", "Organ", "Guitar", "Bass", "Strings", "Ensemble", "Brass",
    "Reed", "Pipe", "Synth Lead", "Synth Pad", "Synth Effects", "Ethnic", "Percussive", "Sound Effects",
]
PROGRAMS_PER_FAMILY = 8
N_PROGRAMS = PROGRAMS_PER_FAMILY * len(FAMILY_NAMES)

# --- fixed values: family number -> (program used when decoding, display name); families 11-15 use their own range ---
FAMILY_TO_PROGRAM = {
    0: (4, "Electric Piano 1"),
    1: (11, "Vibraphone"),
    2: (17, "Percussive Organ"),
    3: (80, "Synth Lead Square"),
    4: (38, "Synth Bass 1"),
    5: (50, "Synth Strings 1"),
    6: (51, "Synth Strings 2"),
    7: (63, "Synth Brass 1"),
    8: (64, "Synth Brass 2"),
    9: (82, "Synth Lead Calliope"),
    10: (81, "Synth Lead Sawtooth"),
}
RANGE_FAMILIES = range(11, 16)

# --- fixed values: General MIDI level 1 program names, programs 0..127 ---
PROGRAM_NAMES = [
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano",
    "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone",
    "Marimba", "Xylophone", "Tubular Bells", "Dulcimer",
    "Drawbar Organ", "Percussive Organ", "Rock Organ", "Church Organ",
    "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)", "Electric Guitar (clean)",
    "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics",
    "Acoustic Bass", "Electric Bass (finger)", "Electric Bass (pick)", "Fretless Bass",
    "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2",
    "Violin", "Viola", "Cello", "Contrabass",
    "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani",
    "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2",
    "Choir Aahs", "Voice Oohs", "Synth Choir", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet",
    "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2",
    "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax",
    "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute",
    "Blown bottle", "Shakuhachi", "Whistle", "Ocarina",
    "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)",
    "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)",
    "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)",
    "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)",
    "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)",
    "Sitar", "Banjo", "Shamisen", "Koto",
    "Kalimba", "Bagpipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock",
    "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal",
    "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet",
    "Telephone Ring", "Helicopter", "Applause", "Gunshot",
]

# --- fixed values: words that mark a title as a derived version, special vocabulary entries, limits ---
# What cleaning takes out of a scraped name. Digits are those of any script.
NAME_SEPARATORS = ",_\n"
BRACKETED_PART = r"\([^)]*\)"
NUMBER_AFTER_DOT = r"\.\p{Nd}+"
VERSION_WORDS = ["karaoke", "reprise", "solo", "acoustic"]
SPECIAL_TOKENS = ["[UNK]", "[PAD]", "[MASK]"]
UNK_ID, PAD_ID, MASK_ID = 0, 1, 2
IGNORED_LABEL = -100
DEFAULT_MAX_TOKENS = 2048
DEFAULT_PROMPT_WORDS = 1500
DEFAULT_MATCH_THRESHOLD = 75
