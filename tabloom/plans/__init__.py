from tabloom.plans.config import PrepConfig
from tabloom.plans.prepare import PrepResult, prepare
from tabloom.plans.state import PrepState
from tabloom.plans.train import TrainResult, score_table, train_suite
from tabloom.plans.workbench import Workbench

__all__ = ["PrepConfig", "PrepResult", "PrepState", "TrainResult", "Workbench", "prepare", "score_table", "train_suite"]
