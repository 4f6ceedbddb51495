"""Default lexicons as plain rows; every scan takes its lexicon as an argument."""

# Cues as (category, phrase, label).
CUES = [
    ("discourse_connective", "on the other hand", "Comparison.Contrast"),
    ("discourse_connective", "in contrast", "Comparison.Contrast"),
    ("discourse_connective", "however", "Comparison.Contrast"),
    ("discourse_connective", "whereas", "Comparison.Contrast"),
    ("discourse_connective", "while", "Comparison.Contrast"),
    ("discourse_connective", "in other words", "Expansion.Equivalence"),
    ("discourse_connective", "as a result", "Contingency.Cause.Result"),
    ("discourse_connective", "in conclusion", "Contingency.Cause.Result"),
    ("discourse_connective", "consequently", "Contingency.Cause.Result"),
    ("discourse_connective", "accordingly", "Contingency.Cause.Result"),
    ("discourse_connective", "therefore", "Contingency.Cause.Result"),
    ("discourse_connective", "thus", "Contingency.Cause.Result"),
    ("discourse_connective", "hence", "Contingency.Cause.Result"),
    ("discourse_connective", "for example", "Expansion.Instantiation"),
    ("discourse_connective", "for instance", "Expansion.Instantiation"),
    ("discourse_connective", "in addition", "Expansion.Conjunction"),
    ("discourse_connective", "furthermore", "Expansion.Conjunction"),
    ("discourse_connective", "moreover", "Expansion.Conjunction"),
    ("discourse_connective", "in particular", "Expansion.Level-of-detail.Arg2-as-detail"),
    ("discourse_connective", "specifically", "Expansion.Level-of-detail.Arg2-as-detail"),
    ("discourse_connective", "in order to", "Contingency.Purpose.Arg2-as-goal"),
    ("discourse_connective", "so that", "Contingency.Purpose.Arg2-as-goal"),
    ("discourse_connective", "even though", "Comparison.Concession.Arg1-as-denier"),
    ("discourse_connective", "although", "Comparison.Concession.Arg1-as-denier"),
    ("discourse_connective", "though", "Comparison.Concession.Arg1-as-denier"),
    ("discourse_connective", "nevertheless", "Comparison.Concession.Arg2-as-denier"),
    ("discourse_connective", "nonetheless", "Comparison.Concession.Arg2-as-denier"),
    ("discourse_connective", "subsequently", "Temporal.Asynchronous.Precedence"),
    ("discourse_connective", "alternatively", "Expansion.Disjunction"),
    ("discourse_connective", "meanwhile", "Temporal.Synchronous"),
    ("discourse_connective", "otherwise", "Contingency.Negative-condition.Arg2-as-negCond"),
    ("discourse_connective", "unless", "Contingency.Negative-condition.Arg2-as-negCond"),
    ("discourse_connective", "because", "Contingency.Cause.Reason"),
    ("discourse_connective", "since", "Contingency.Cause.Reason"),
    ("discourse_connective", "instead", "Expansion.Substitution.Arg2-as-subst"),
    ("epistemic_marker", "beyond doubt", "booster"),
    ("epistemic_marker", "without doubt", "booster"),
    ("epistemic_marker", "undoubtedly", "booster"),
    ("epistemic_marker", "definitely", "booster"),
    ("epistemic_marker", "certainly", "booster"),
    ("epistemic_marker", "obviously", "booster"),
    ("epistemic_marker", "clearly", "booster"),
    ("epistemic_marker", "necessarily", "booster"),
    ("epistemic_marker", "presumably", "hedge"),
    ("epistemic_marker", "apparently", "hedge"),
    ("epistemic_marker", "allegedly", "hedge"),
    ("epistemic_marker", "reportedly", "hedge"),
    ("epistemic_marker", "arguably", "hedge"),
    ("epistemic_marker", "generally", "hedge"),
    ("epistemic_marker", "typically", "hedge"),
    ("epistemic_marker", "probably", "hedge"),
    ("epistemic_marker", "possibly", "hedge"),
    ("epistemic_marker", "unlikely", "hedge"),
    ("epistemic_marker", "perhaps", "hedge"),
    ("epistemic_marker", "likely", "hedge"),
    ("epistemic_marker", "might", "modal_hedge"),
    ("epistemic_marker", "could", "modal_hedge"),
    ("epistemic_marker", "must", "modal_booster"),
    ("speech_act_cue", "we recommend", "directive"),
    ("speech_act_cue", "i recommend", "directive"),
    ("speech_act_cue", "we propose", "directive"),
    ("speech_act_cue", "i propose", "directive"),
    ("speech_act_cue", "must not", "prohibition"),
    ("speech_act_cue", "shall not", "prohibition"),
    ("speech_act_cue", "hereby", "declaration"),
    ("speech_act_cue", "promise", "commissive"),
    ("speech_act_cue", "guarantee", "commissive"),
    ("speech_act_cue", "commit to", "commissive"),
    ("speech_act_cue", "undertake to", "commissive"),
    ("speech_act_cue", "concede", "concession"),
    ("speech_act_cue", "disagree", "disagreement"),
    ("speech_act_cue", "object to", "objection"),
    ("speech_act_cue", "contend", "assertive"),
]
# Speakers that are named as unknown.
UNATTRIBUTED = ("unattributed", "unknown", "unidentified", "?")
# Markers that open a clause, as (language, marker, relation).
OPENING_MARKERS = [
    ("en", "however", "contrast"),
    ("en", "nevertheless", "contrast"),
    ("en", "in contrast", "contrast"),
    ("en", "on the other hand", "contrast"),
    ("en", "yet", "contrast"),
    ("en", "but", "contrast"),
    ("en", "although", "concession"),
    ("en", "even though", "concession"),
    ("en", "even if", "concession"),
    ("en", "despite", "concession"),
    ("en", "in spite of", "concession"),
    ("en", "as a result", "result"),
    ("en", "therefore", "result"),
    ("en", "thus", "result"),
    ("en", "hence", "result"),
    ("en", "because", "cause"),
    ("en", "due to", "cause"),
    ("en", "if", "condition"),
    ("en", "unless", "condition"),
    ("en", "provided that", "condition"),
    ("en", "for example", "evidence"),
    ("en", "for instance", "evidence"),
    ("de", "jedoch", "contrast"),
    ("de", "aber", "contrast"),
    ("de", "dagegen", "contrast"),
    ("de", "obwohl", "concession"),
    ("de", "trotz", "concession"),
    ("de", "daher", "result"),
    ("de", "deshalb", "result"),
    ("de", "folglich", "result"),
    ("de", "weil", "cause"),
    ("de", "da", "cause"),
    ("de", "wenn", "condition"),
    ("de", "falls", "condition"),
    ("de", "zum beispiel", "evidence"),
    ("fr", "cependant", "contrast"),
    ("fr", "mais", "contrast"),
    ("fr", "toutefois", "contrast"),
    ("fr", "bien que", "concession"),
    ("fr", "malgré", "concession"),
    ("fr", "donc", "result"),
    ("fr", "par conséquent", "result"),
    ("fr", "parce que", "cause"),
    ("fr", "car", "cause"),
    ("fr", "si", "condition"),
    ("fr", "par exemple", "evidence"),
    ("es", "sin embargo", "contrast"),
    ("es", "pero", "contrast"),
    ("es", "no obstante", "contrast"),
    ("es", "aunque", "concession"),
    ("es", "a pesar de", "concession"),
    ("es", "por lo tanto", "result"),
    ("es", "por eso", "result"),
    ("es", "porque", "cause"),
    ("es", "ya que", "cause"),
    ("es", "si", "condition"),
    ("es", "por ejemplo", "evidence"),
    ("ru", "однако", "contrast"),
    ("ru", "но", "contrast"),
    ("ru", "хотя", "concession"),
    ("ru", "несмотря на", "concession"),
    ("ru", "поэтому", "result"),
    ("ru", "следовательно", "result"),
    ("ru", "потому что", "cause"),
    ("ru", "так как", "cause"),
    ("ru", "если", "condition"),
    ("ru", "например", "evidence"),
    ("zh", "但是", "contrast"),
    ("zh", "然而", "contrast"),
    ("zh", "虽然", "concession"),
    ("zh", "尽管", "concession"),
    ("zh", "因此", "result"),
    ("zh", "所以", "result"),
    ("zh", "因为", "cause"),
    ("zh", "由于", "cause"),
    ("zh", "如果", "condition"),
    ("zh", "例如", "evidence"),
]
