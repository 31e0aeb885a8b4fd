"""Row types. Times are seconds from the start of a call unless a caller chose another unit.

A segment is half-open, [start, end), on channel 0 (caller) or 1 (agent); seq breaks ties of start.
"""

from __future__ import annotations

CALLER, AGENT = 0, 1

MANIFEST = "anon_id string, label string, split string, duration_s double"
TURN_FILE = "turns array<struct<channel: int, start: double, end: double>>"
TRANSCRIPT_FILE = "turns array<struct<channel: int, start: double, end: double, text: string>>"
SEGMENTS = "call_id string, seq int, channel int, start double, end double"
TRANSCRIPTS = "call_id string, seq int, channel int, start double, end double, text string"
AUDIO = "call_id string, pcm0 binary, pcm1 binary, n0 long, n1 long, sample_rate int, error string"
REQUESTS = "audio_base64 string, audio_b64 string, call_id string, sample_rate int, channels int"
LEDGER = "call_id string, event_idx int, channel int, start double, end double, type string"
SPEECH, OVERLAP, SILENCE = "speech", "overlap", "silence"

#: The fixed names of the timing, acoustic, recovery, micro and interaction layers, in order.
TIMING_NAMES = (
    "caller_talk_ratio", "agent_talk_ratio", "overlap_ratio", "silence_ratio", "caller_segment_count", "agent_segment_count", "overlap_event_count", "overlap_total_s",
    "caller_utterance_mean_s", "caller_utterance_std_s", "caller_utterance_median_s", "caller_utterance_cv",
    "agent_utterance_mean_s", "agent_utterance_std_s", "agent_utterance_median_s", "agent_utterance_cv",
    "caller_response_latency_mean_s", "caller_response_latency_std_s", "caller_response_latency_cv", "caller_response_latency_median_s", "caller_response_latency_min_s", "caller_response_latency_max_s",
    "caller_response_latency_pos_mean_s", "caller_response_latency_pos_median_s", "caller_response_latency_pos_min_s", "caller_response_latency_pos_max_s", "caller_response_latency_pos_cv",
    "agent_response_latency_mean_s", "agent_response_latency_std_s", "agent_response_latency_cv", "turn_ratio", "caller_vs_agent_speech", "caller_turns_per_min", "caller_sec_per_turn",
)
ACOUSTIC_NAMES = (
    "caller_rms_mean", "caller_rms_std", "caller_rms_cv", "caller_zcr_mean", "caller_zcr_std", "caller_spectral_centroid_mean", "caller_spectral_centroid_std", "caller_spectral_flatness_mean",
    "caller_spectral_flatness_std", "caller_hf_lf_ratio_mean", "caller_hf_lf_ratio_std", "caller_crest_factor_mean", "caller_crest_factor_std", "caller_crest_factor_cv",
    "caller_intra_silence_gap_mean_s", "caller_intra_silence_gap_cv", "caller_segment_length_cv",
)
RECOVERY_NAMES = (
    "agent_aligned_recovery_count", "agent_aligned_recovery_mean_s", "agent_aligned_recovery_std_s", "agent_aligned_recovery_cv", "agent_aligned_recovery_utterance_mean_s",
    "agent_aligned_recovery_utterance_std_s", "agent_aligned_recovery_utterance_cv", "post_overlap_recovery_mean_s", "post_overlap_recovery_cv", "post_overlap_recovery_count",
    "caller_barge_in_count", "caller_backchannel_count", "agent_turn_fragmentation",
)
MICRO_NAMES = (
    "caller_formant_f1_std", "caller_formant_f2_std", "caller_formant_f3_std", "caller_formant_volatility_mean", "caller_pitch_jitter", "caller_pitch_shimmer", "caller_f0_std", "caller_f0_cv",
    "caller_hnr_mean", "caller_hnr_std", "caller_hnr_cv", "caller_pause_entropy", "caller_lfcc_delta_delta_std",
)
INTERACTION_NAMES = (
    "caller_breath_event_rate", "caller_breath_gap_ratio", "cross_channel_energy_correlation", "caller_yield_decay_mean_db", "caller_yield_decay_std_db",
    "caller_agent_echo_correlation", "caller_agent_bleed_correlation",
)
SEMANTIC_NAMES = ("digit_trap_count", "digit_trap_caller_objected", "false_dilemma_count", "announced_interrupt_count", "caller_filler_count")
FEATURE_NAMES = ("duration_s", *TIMING_NAMES, *ACOUSTIC_NAMES, *RECOVERY_NAMES, *MICRO_NAMES, *INTERACTION_NAMES)
#: What a microphone would hear, against who talks when; duration_s is in neither group.
SOUND = frozenset(ACOUSTIC_NAMES + MICRO_NAMES + INTERACTION_NAMES)


def acoustic_names(names=FEATURE_NAMES) -> list[str]:
    return [n for n in names if n in SOUND]


def behavioural_names(names=FEATURE_NAMES) -> list[str]:
    return [n for n in names if n not in SOUND and n != "duration_s"]
